"""Queries over scalar functions, and over streams drained to their end. name -> (query, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.functions import attrs, text, times
from faultloom.operators import ranking, reason, rules, tokens
from faultloom.plans import bindings as b
from faultloom.plans import links, telemetry
from faultloom.plans.bindings import sql
from faultloom.streaming import events

RULE_NAMES = [f"rel_{k}" for k in range(10)]


def rule_texts(s: SparkSession, d: str) -> DataFrame:
    r = links.found_rules(s, d).filter("rule_supp > 20")
    names, none = F.array(*[F.lit(n) for n in RULE_NAMES]), F.array().cast("array<array<int>>")
    line = rules.verbalize(F.col("head_rel"), F.array("b0", "b1"), none, names, F.col("conf"), F.col("rule_supp"), F.col("body_supp"))
    return r.select("head_rel", "b0", "b1", line.alias("rule"))


_TEXT = links._RULES + ", v_text AS (SELECT head_rel, b0, b1, printf('%8.6f  %4d  %4d  ', conf, rule_supp, body_supp) || 'rel_' || head_rel || '(X0,X2,T2)<-rel_' || b0 || '(X0,X1,T0)&rel_' || b1 || '(X1,X2,T1)' AS rule FROM v_rules WHERE rule_supp > 20)"


def streamed(s: SparkSession, d: str) -> DataFrame:
    return events.source(s, d, "events.parquet")


_E = "SELECT event_id, ts, 'svc' || CAST(user_id % 20 AS VARCHAR) AS service, event_type AS type, value FROM events"

QUERIES: dict = {
    "st1_log_level": (
        lambda s, d: b.read(s, d, "events").select(text.log_level(F.concat("event_type", F.lit(" "), F.when(F.col("event_id") % 5 == 0, "Warned").otherwise(""))).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n")),
        "SELECT CASE WHEN regexp_matches(m, 'error|exception|fail|critical') THEN 'ERROR' WHEN regexp_matches(m, 'warn|alert|notice') THEN 'WARN' ELSE 'UNKNOWN' END AS level, count(*) AS n FROM (SELECT lower(event_type || ' ' || CASE WHEN event_id % 5 = 0 THEN 'Warned' ELSE '' END) AS m FROM events) GROUP BY 1",
    ),
    "st3_relation_names": (
        lambda s, d: b.read(s, d, "orders").select(text.camel_to_words(F.lit("makeVisitTo")).alias("a"), text.clean_relation(F.concat(F.lit("_"), F.lower("o_orderpriority"), F.lit("_x&y_"))).alias("b"), text.safe_name(F.col("o_orderpriority")).alias("c")).distinct(),
        "SELECT DISTINCT 'make visit to' AS a, regexp_replace(regexp_replace('_' || lower(o_orderpriority) || '_x&y_', '^_+|_+$', '', 'g'), '[_&]', ' ', 'g') AS b, regexp_replace(o_orderpriority, '[^A-Za-z0-9._-]+', '_', 'g') AS c FROM orders",
    ),
    "st6_rule_texts": (lambda s, d: rule_texts(s, d), sql("SELECT * FROM v_text", "v_train", more=_TEXT)),
    "st8_rule_paths": (
        lambda s, d: rule_texts(s, d).select(text.rule_path(F.regexp_replace("rule", r"^.*\d  ", "")).alias("p")).select("p.head", "p.body").groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.min("body").alias("body")),
        sql("SELECT 'rel_' || head_rel AS head, count(*) AS n, min('rel_' || b0 || '|rel_' || b1) AS body FROM v_text GROUP BY 1", "v_train", more=_TEXT),
    ),
    "st9_rules_by_head": (
        lambda s, d: rule_texts(s, d).groupBy("head_rel").agg(F.array_join(F.sort_array(F.collect_list(text.strip_columns(F.trim("rule")))), ";").alias("rules")),
        sql("SELECT head_rel, string_agg(line, ';' ORDER BY line) AS rules FROM (SELECT head_rel, array_to_string(p[4:], ' ') || '&' || p[1] AS line FROM (SELECT head_rel, string_split_regex(trim(rule), '\\s+') AS p FROM v_text)) GROUP BY 1", "v_train", more=_TEXT),
    ),
    "st12_chain_rules": (
        lambda s, d: rule_texts(s, d).select("head_rel", text.is_chain(F.regexp_replace("rule", r"^.*\d  ", "")).alias("ok")).groupBy("ok").agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT true AS ok, count(*) AS n FROM v_text", "v_train", more=_TEXT),
    ),
    "st13_rules_from_paths": (
        lambda s, d: rule_texts(s, d).select(F.regexp_replace("rule", r"^.*\d  ", "").alias("rule")).select("rule", text.rule_from_path(text.rule_path(F.col("rule"))).alias("again")).filter("rule = again").groupBy().agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT count(*) AS n FROM v_text", "v_train", more=_TEXT),
    ),
    "dt2_parsed_times": (
        lambda s, d: b.read(s, d, "events").select("event_id", F.floor(times.parse_time(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).alias("t"), F.floor(times.parse_time((b.epoch("ts") * 1000).cast("string"))).alias("ms")),
        "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(floor(epoch(ts)) AS BIGINT) AS ms FROM events",
    ),
    "dt3_local_days": (
        lambda s, d: b.metrics(s, d).groupBy(times.local_date_name(F.col("t")).alias("day")).agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT strftime(TIMESTAMP '1970-01-01' + to_seconds(t + 28800), '%Y_%m_%d') AS day, count(*) AS n FROM v_metrics GROUP BY 1", "v_metrics"),
    ),
    "dt4_window_in_text": (
        lambda s, d: b.read(s, d, "events").select("event_id", F.concat(F.lit("On "), F.date_format("ts", "MMMM d, yyyy"), F.lit(", between 14:30 and 15:00, things failed")).alias("x")).select("event_id", times.window_in_text(F.col("x")).alias("w")).select("event_id", "w.start", "w.end"),
        "SELECT event_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) + 14 * 3600 + 1800 - 28800 AS start, CAST(epoch(date_trunc('day', ts)) AS BIGINT) + 15 * 3600 - 28800 AS \"end\" FROM events",
    ),
    "dt7_hours_between": (
        lambda s, d: b.read(s, d, "orders").select("o_orderkey", times.hours_between(F.lit("1995-01-01"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("hours")),
        "SELECT o_orderkey, date_diff('hour', TIMESTAMP '1995-01-01', date_trunc('day', o_orderdate)) AS hours FROM orders",
    ),
    "dt8_minutes_around": (
        lambda s, d: b.metrics(s, d).select("t", F.explode(times.minutes_around(F.col("t"))).alias("minute")),
        sql("SELECT t, unnest(range((t - 150) - (t - 150) % 60, t + 151, 60)) AS minute FROM v_metrics", "v_metrics"),
    ),
    "js2_typed_attributes": (
        lambda s, d: b.read(s, d, "events").select(attrs.coerce(F.when(F.col("event_id") % 4 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 4 == 1, F.col("event_type")).when(F.col("event_id") % 4 == 2, "true")).alias("x")).groupBy("x.kind").agg(F.count(F.lit(1)).alias("n"), F.sum("x.i").alias("i")),
        "SELECT CASE event_id % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'string' WHEN 2 THEN 'bool' ELSE 'null' END AS kind, count(*) AS n, sum(CASE WHEN event_id % 4 = 0 THEN event_id END)::BIGINT AS i FROM events GROUP BY 1",
    ),
    "js1_merged_attributes": (
        lambda s, d: b.read(s, d, "events").select("event_id", F.element_at(attrs.merge_attrs(F.create_map(F.lit("k"), F.lit("base"), F.lit("only"), F.lit("here")), attrs.clean_attrs(F.when(F.col("event_id") % 2 == 0, '{"k": "over"}').otherwise("no json"))), "k").alias("k")),
        "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'over' ELSE 'base' END AS k FROM events",
    ),
    "ar1_repeated_groups": (
        lambda s, d: b.read(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_suppkey") % 4)).alias("v")).select("l_orderkey", F.size(attrs.repeated_groups(F.col("v"))).alias("groups")),
        "SELECT l_orderkey, CAST(count(*) FILTER (WHERE n > 1) AS INTEGER) AS groups FROM (SELECT l_orderkey, l_suppkey % 4 AS k, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    ),
    "sc1_scores": (
        lambda s, d: b.read(s, d, "orders").select(
            "o_orderkey",
            *[F.round(reason.confidence_score(F.col("o_orderkey") / 1000, F.col("o_custkey") / 10000, k), 6).alias(k) for k in ("common", "llm", "or", "and")],
            F.round(reason.scaled_score(F.col("o_orderkey") / 1000, reason.decay(F.lit(10), F.lit(12), 0.1), 0.3, F.lit(0.5)), 6).alias("scaled"),
        ),
        "SELECT o_orderkey, round(o_orderkey / 1000, 6) AS common, round(o_custkey / 10000, 6) AS llm, round(greatest(o_orderkey / 1000, o_custkey / 10000), 6) AS \"or\", round(0.5 * (o_orderkey / 1000) + 0.5 * (o_custkey / 10000), 6) AS \"and\", round(0.3 * (o_orderkey / 1000 * 0.5) + 0.7 * exp(-0.2::DOUBLE), 6) AS scaled FROM orders",
    ),
    "llm10_evidence_confidence": (
        lambda s, d: telemetry.errors(s, d).groupBy("service").agg(F.count(F.lit(1)).alias("n")).select("service", F.round(ranking.evidence_confidence(F.col("n"), F.lit(85)), 6).alias("confidence"), ranking.advice(ranking.evidence_confidence(F.col("n"), F.lit(85))).alias("advice")),
        sql("SELECT service, round(0.7 + CASE WHEN n > 10 THEN 0.3 ELSE 0 END, 6) AS confidence, CASE WHEN n > 10 THEN 'act' ELSE 'inspect' END AS advice FROM (SELECT service, count(*) AS n FROM v_errors GROUP BY 1)", "v_errors"),
    ),
    "sc7_score_modes": (
        lambda s, d: b.read(s, d, "orders").select(
            "o_orderkey",
            *[F.round(reason.score_of(m, F.col("o_orderkey") / 1000, F.lit(10), F.lit(11), F.lit(12), 0.3, 0.1, F.lit(0.5)), 6).alias(m) for m in ("origin", "transformer", "end")],
        ),
        "SELECT o_orderkey, round(0.3 * (o_orderkey / 1000) + 0.7 * exp(-0.2::DOUBLE), 6) AS origin, round(0.3 * (o_orderkey / 1000 * 0.5) + 0.7 * exp(-0.2::DOUBLE), 6) AS transformer, round(0.3 * (o_orderkey / 1000) + 0.7 * exp(-0.1::DOUBLE), 6) AS \"end\" FROM orders",
    ),
    "set4_heads_without_samples": (
        lambda s, d: rules.heads_without(b.metrics(s, d).select(F.col("service").alias("head")), telemetry.errors(s, d).select(F.col("service").alias("head"))),
        sql("SELECT service AS head FROM v_metrics EXCEPT SELECT service FROM v_errors", "v_metrics", "v_errors"),
    ),
    "set5_all_texts": (
        lambda s, d: rules.all_texts(*[b.logs(s, d).filter(F.col("level") == level).select("message") for level in ("ERROR", "WARN")]),
        sql("SELECT message FROM v_logs WHERE level = 'ERROR' UNION SELECT message FROM v_logs WHERE level = 'WARN'", "v_logs"),
    ),
    "ag29_evidence": (
        lambda s, d: telemetry.errors(s, d).groupBy("service").agg(F.collect_list("message").alias("evidence")).select("service", F.round(ranking.total_evidence(F.array(F.size("evidence"))), 6).alias("confidence")),
        sql("SELECT service, round(least(count(*) / 10, 1), 6) AS confidence FROM v_errors GROUP BY 1", "v_errors"),
    ),
    "h13_sure_service": (
        lambda s, d: ranking.sure_service(telemetry.errors(s, d).groupBy("service").agg(F.count(F.lit(1)).alias("n")).select("service", (F.col("n") / 1000).alias("confidence")), 0.0).select("service", F.round("confidence", 6).alias("confidence")),
        sql("SELECT service, round(count(*) / 1000, 6) AS confidence FROM v_errors GROUP BY 1 ORDER BY count(*) DESC, service LIMIT 1", "v_errors"),
    ),
    "h12_evidence_lookup": (
        lambda s, d: ranking.evidence_of(telemetry.errors(s, d).select("service", F.col("seq").alias("evidence")), s.createDataFrame([("svc3",), ("svc7",), ("none",)], "service string")).select("service", F.size("evidence").alias("n")),
        sql("SELECT x.service, CAST(count(e.service) AS INTEGER) AS n FROM (SELECT unnest(['svc3', 'svc7', 'none']) AS service) x LEFT JOIN v_errors e ON e.service = x.service GROUP BY 1", "v_errors"),
    ),
    "tx1_token_counts": (
        lambda s, d: b.read(s, d, "documents").select("doc_id", tokens.counts(F.col("text")).alias("n")),
        r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents",
    ),
    "tx2_packed_prompts": (lambda s, d: tokens.packed(b.read(s, d, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("seq"), "text"), 200), None),
    "tx3_trimmed_prompts": (
        lambda s, d: tokens.trimmed(b.read(s, d, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("seq"), "text"), 200).select("key", "seq"),
        r"SELECT key, seq FROM (SELECT CAST(conv_id AS VARCHAR) AS key, turn AS seq, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM conversations) WHERE upto <= 200",
    ),
    "str2_sliding_windows": (
        lambda s, d: events.drain(events.sliding_counts(streamed(s, d)), ["start", "service"], "sliding").select(F.unix_seconds("start").alias("start"), "service", "n", "errors"),
        f"SELECT w AS start, service, count(*) AS n, count(*) FILTER (WHERE type = 'error') AS errors FROM (SELECT *, unnest(range(CAST(floor(epoch(ts)) AS BIGINT) // 300 * 300 - 3300, CAST(floor(epoch(ts)) AS BIGINT) // 300 * 300 + 1, 300)) AS w FROM ({_E})) GROUP BY 1, 2",
    ),
    "str1_minute_stream": (
        lambda s, d: events.drain(events.minute_counts(streamed(s, d)), ["minute_ts", "service"], "minutes"),
        f"SELECT CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 AS minute_ts, service, count(*) AS n FROM ({_E}) GROUP BY 1, 2",
    ),
    "str3_service_states": (
        lambda s, d: events.drain(events.service_states(streamed(s, d)), ["service"], "states"),
        f"SELECT service, count(*) FILTER (WHERE type = 'error') AS error_count, max(CAST(floor(epoch(ts)) AS BIGINT)) FILTER (WHERE type = 'error') AS last_error, count(*) FILTER (WHERE type = 'error') > 5 AS anomalous FROM ({_E}) GROUP BY 1",
    ),
    "st7_rule_ids": (
        lambda s, d: rules.ids_in_text(rule_texts(s, d).select(F.regexp_replace("rule", r"^.*\d  ", "").alias("rule")), s.createDataFrame(list(enumerate(RULE_NAMES)), "id int, name string")).select("rule", "head", rules.body_code(F.col("body")).alias("body")),
        sql(r"SELECT regexp_replace(rule, '^.*\d  ', '') AS rule, CAST(head_rel AS INTEGER) AS head, b0 || '|' || b1 AS body FROM v_text", "v_train", more=_TEXT),
    ),
    "st11_walks_of_rules": (
        lambda s, d: links.found_rules(s, d).select("head_rel", "b0", "b1", rules.walk_of_rule(F.col("head_rel"), F.array("b0", "b1"), 5).alias("w")).select("head_rel", "b0", "b1", F.array_join("w.relations", ",").alias("relations"), F.array_join("w.entities", ",").alias("entities")),
        sql("SELECT head_rel, b0, b1, head_rel || ',' || (b1 + 5) % 10 || ',' || (b0 + 5) % 10 AS relations, '0,2,1,0' AS entities FROM v_rules", "v_train", more=links._RULES),
    ),
    "st14_body_codes": (
        lambda s, d: links.found_rules(s, d).select(rules.body_of(rules.body_code(F.array("b0", "b1"))).alias("b")).groupBy(F.get("b", F.lit(1)).alias("b1")).agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT b1, count(*) AS n FROM v_rules GROUP BY 1", "v_train", more=links._RULES),
    ),
    "st16_similar_relations": (
        lambda s, d: rules.with_similar(links.found_rules(s, d).filter("conf > 0.05").select(F.col("b0").alias("rel")).distinct(), s.range(10).select(F.col("id").cast("int").alias("rel"), ((F.col("id") + 5) % 10).cast("int").alias("other"))),
        sql("SELECT b0 AS rel FROM v_rules WHERE conf > 0.05 UNION SELECT (b0 + 5) % 10 FROM v_rules WHERE conf > 0.05", "v_train", more=links._RULES),
    ),
    "ag28_rule_differences": (
        lambda s, d: (lambda r: rules.difference_statistics(r.filter("b0 < 4"), r.filter("b1 < 6"), ["head_rel", "b0", "b1"]))(links.found_rules(s, d)),
        sql("SELECT count(*) FILTER (WHERE b0 < 4 AND b1 < 6) AS both, count(*) FILTER (WHERE b0 < 4 AND NOT b1 < 6) AS only_before, count(*) FILTER (WHERE b1 < 6 AND NOT b0 < 4) AS only_after FROM v_rules", "v_train", more=links._RULES),
    ),
    "h3_rules_by_head": (
        lambda s, d: rules.by_head(rule_texts(s, d).select(F.col("head_rel").alias("head"), "rule"), s.createDataFrame(list(enumerate(RULE_NAMES)), "id int, name string")).select("name", F.size("rules").alias("n")),
        sql("SELECT 'rel_' || head_rel AS name, CAST(count(DISTINCT rule) AS INTEGER) AS n FROM v_text GROUP BY 1", "v_train", more=_TEXT),
    ),
}
