"""Queries over readers and writers: tables go out in a file format, come back through its reader, and equal the tables
they were made of. name -> (query, SQL)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.functions import times
from faultloom.operators import quads
from faultloom.plans import bindings as b
from faultloom.plans import causes, links
from faultloom.plans import telemetry as tel
from faultloom.plans.bindings import TARGET_FROM, TARGET_TO, sql
from faultloom.sources import readers, store, writers
from faultloom.sources.shared import cut, shared_folder

TEXT = {"escape": '"', "header": True}


def place(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/faultloom-files-{name}-{uuid.uuid4().hex}"


def out(rows: DataFrame, name: str, form: str, **options) -> str:
    """The folder that rows were written to."""
    path = place(rows.sparkSession, name)
    rows.write.options(**options).format(form).save(path)
    return path


def metric_csv(s: SparkSession, d: str) -> DataFrame:
    rows = b.metrics(s, d).select(F.col("t").alias("timestamp"), F.col("service").alias("cmdb_id"), F.col("metric").alias("kpi_name"), "value")
    return readers.metric_csv(s, out(rows, "metric", "csv", **TEXT))


def metric_text(s: SparkSession, d: str, keep_bad: bool) -> DataFrame:
    """ISO times; every fifth value is no number."""
    iso = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    bad = F.when(F.col("t") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    rows = b.metrics(s, d).select(iso.alias("time"), "service", "metric", bad.alias("value"))
    return readers.metric_rows(s, out(rows, "metric-text", "csv", **TEXT), keep_bad).select(F.floor("time").alias("t"), "service", "metric", "value")


def log_csv(s: SparkSession, d: str) -> DataFrame:
    rows = b.read(s, d, "events").select(b.epoch("ts").alias("timestamp"), F.concat(F.lit("svc"), (F.col("user_id") % 20).cast("string")).alias("cmdb_id"), F.col("event_type").alias("log_name"), F.col("props").alias("value"))
    return readers.log_csv(s, out(rows, "log", "csv", **TEXT), TARGET_FROM, TARGET_TO).select("time", "service", "level", "message")


def log_lines(s: SparkSession, d: str) -> DataFrame:
    """JSON lines under two sets of keys, and plain lines."""
    e = b.read(s, d, "events").withColumn("at", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).withColumn("svc", F.concat(F.lit("svc"), (F.col("user_id") % 20).cast("string")))
    one = F.to_json(F.struct(F.col("at").alias("timestamp"), F.col("svc").alias("service"), F.lit("warn").alias("level"), F.col("event_type").alias("message")))
    two = F.to_json(F.struct(b.epoch("ts").alias("ts"), F.col("svc").alias("component"), F.col("event_type").alias("msg")))
    plain = F.concat_ws(" ", "at", F.lit("ERROR"), "svc", F.concat(F.lit("plain "), "event_type"))
    kind = F.col("event_id") % 3
    rows = e.select(F.when(kind == 0, one).when(kind == 1, two).otherwise(plain).alias("value"))
    return readers.log_lines(s, out(rows, "lines", "text")).groupBy(F.floor("time").alias("t"), "service", "level", "message").agg(F.count(F.lit(1)).alias("n"))


def span_csv(s: SparkSession, d: str) -> DataFrame:
    name = lambda seq: F.concat_ws("-", F.col("trace_id").cast("string"), seq.cast("string"))
    rows = b.spans(s, d).select((F.col("t") * 1000).alias("timestamp"), F.col("service").alias("cmdb_id"), F.when(F.col("seq") > 1, name(F.col("seq") - 1)).otherwise("").alias("parent_id"), name(F.col("seq")).alias("span_id"), F.col("trace_id").cast("string").alias("trace_id"), F.col("seq").alias("duration"))
    return readers.span_csv(s, out(rows, "span", "csv", **TEXT), 0, 10**10).select("trace_id", "span_id", "parent_id", "service", "start_time", "duration")


def span_json(s: SparkSession, d: str, nested: bool) -> DataFrame:
    """A trace export a file row: traces with their processes, or spans by themselves."""
    spans = b.spans(s, d)
    span_id = lambda seq: F.concat_ws("-", F.col("trace_id").cast("string"), seq.cast("string"))
    up = F.when(F.col("seq") > 1, F.array(F.struct(F.lit("CHILD_OF").alias("refType"), span_id(F.col("seq") - 1).alias("spanID"))))
    common = [F.col("trace_id").cast("string").alias("traceID"), span_id(F.col("seq")).alias("spanID"), F.lit("op").alias("operationName"), F.col("t").cast("double").alias("startTime"), F.col("seq").alias("duration")]
    if nested:
        span = F.struct(*common, F.concat(F.lit("p"), F.col("seq").cast("string")).alias("processID"), up.alias("references"))
        process = F.struct(F.concat(F.lit("p"), F.col("seq").cast("string")).alias("id"), F.col("service").alias("serviceName"))
        rows = spans.groupBy("trace_id").agg(F.array(F.struct(F.collect_list(process).alias("processes"), F.collect_list(span).alias("spans"))).alias("data")).select("data")
    else:
        rows = spans.select(*common, F.col("service").alias("serviceName"), F.when(F.col("seq") > 1, span_id(F.col("seq") - 1)).alias("parentSpanID"))
    read = readers.span_json(s, out(rows, "traces", "json"), multi_line=False)
    return read.select("trace_id", "span_id", "parent_id", "service", "start_time", "duration")


_SPANS = "SELECT CAST(trace_id AS VARCHAR) AS trace_id, trace_id || '-' || seq AS span_id, CASE WHEN seq > 1 THEN trace_id || '-' || (seq - 1) END AS parent_id, service, t AS start_time, seq AS duration FROM v_spans"


def named_quads(s: SparkSession, d: str) -> DataFrame:
    """Quadruples as names in a text file, read and coded again: entities and relations by their names' order."""
    q = b.quads(s, d)
    text = lambda p, c: F.concat(F.lit(p), F.lpad(F.col(c).cast("string"), 8, "0")).alias({"s": "subject", "o": "object", "r": "relation"}[c])
    read = readers.quad_tsv(s, out(q.select(text("e", "s"), text("rel", "r"), text("e", "o"), F.date_add(F.lit("1992-01-01").cast("date"), F.col("t")).cast("string").alias("timestamp")), "quads", "csv", sep="\t"))
    read = cut(read, "named-quads")
    names = quads.dictionary(read.select(F.col("subject").alias("name")).union(read.select("object")), "name")
    coded = quads.encode(quads.encode(read, names, "subject", "s"), names, "object", "o")
    return coded.select("s", F.substr("relation", F.lit(4)).cast("int").alias("r"), "o", F.datediff("timestamp", F.lit("1992-01-01").cast("date")).alias("t"))


def triples(s: SparkSession, d: str, **options) -> DataFrame:
    q = b.quads(s, d).select(*[F.col(c).cast("string") for c in ("s", "r", "o")]).distinct()
    return readers.triple_tsv(s, out(q, "triples", "csv", sep="\t"), **options)


def names(s: SparkSession, d: str) -> DataFrame:
    rows = b.read(s, d, "part").select("p_name").distinct().orderBy("p_name").coalesce(1)
    return readers.name_list(s, out(rows.select(F.col("p_name").alias("value")), "names", "text"))


def name_map(s: SparkSession, d: str) -> DataFrame:
    pairs = b.read(s, d, "supplier").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("s_name", F.col("s_suppkey").cast("int"))))).alias("value"))
    return readers.name_map(s, out(pairs, "map", "text"))


def scored(s: SparkSession, d: str) -> DataFrame:
    path = place(s, "candidates")
    writers.candidates(links.cands(s, d).select("query_id", "cand", "score"), path)
    return links.R(readers.candidates(s, path))


def rule_files(s: SparkSession, d: str, part: str) -> DataFrame:
    """Rules in three forms; ``part`` is the one to read again."""
    rows = links.full_rules(s, d).withColumn("var_constraints", F.array().cast("array<array<int>>"))
    folder = place(s, "rules")
    writers.rules_all(rows, [f"rel_{k}" for k in range(10)], folder)
    if part == "json":
        return readers.rules_json(s, f"{folder}/rules.json").select("head_rel", F.array_join("body_rels", ",").alias("body"), "conf", "rule_supp", "body_supp")
    if part == "text":
        return s.read.text(f"{folder}/rules.txt").select(F.col("value").alias("rule"))
    return s.read.schema("head_rel int, rules array<string>").json(f"{folder}/rules_by_head.json").select("head_rel", F.explode("rules").alias("rule"))


_TEXT = links._RULES + ", v_text AS (SELECT head_rel, printf('%8.6f  %4d  %4d  ', conf, rule_supp, body_supp) || 'rel_' || head_rel || '(X0,X2,T2)<-rel_' || b0 || '(X0,X1,T0)&rel_' || b1 || '(X1,X2,T1)' AS rule FROM v_rules)"


def path_lines(s: SparkSession, d: str) -> DataFrame:
    p, _, _ = causes.paths(s, d)
    path = place(s, "paths")
    writers.paths_jsonl(p.select(F.xxhash64("path_id").alias("path_id"), "path"), path)
    return readers.paths_jsonl(s, path).select(F.get("path", F.lit(0)).alias("n0"), F.get("path", F.lit(1)).alias("n1"), F.get("path", F.lit(2)).alias("n2"))


def graph_csv(s: SparkSession, d: str, trimmed: bool) -> DataFrame:
    """Nodes and edges as CSV with their attributes as JSON text, read again."""
    folder = place(s, "graph-csv")
    if trimmed:
        writers.trimmed_csv(*tel.tkg(s, d), folder, ("log_event",), ("calls",))
    else:
        writers.graph_csv(*tel.tkg(s, d), folder)
    read = lambda name: s.read.csv(f"{folder}/{name}.csv", **TEXT)
    attr = lambda c, kind="string": F.get_json_object("attrs", f"$.{c}").cast(kind)
    n = read("nodes").select("id", F.col("node_type").alias("kind"), attr("minute_ts", "long").alias("minute_ts"), F.round(attr("zscore", "double"), 6).alias("x"))
    e = read("edges").select(F.concat_ws(">", "src", "dst").alias("id"), F.col("edge_type").alias("kind"), attr("minute_ts", "long").alias("minute_ts"), attr("weight", "double").alias("x"))
    return n.unionByName(e)


_BOTH = "SELECT id, node_type AS kind, minute_ts, round(zscore, 6) AS x FROM v_nodes UNION ALL SELECT src || '>' || dst, edge_type, minute_ts, weight FROM v_edges"
_TRIMMED = """SELECT id, node_type AS kind, minute_ts, round(zscore, 6) AS x FROM v_nodes WHERE node_type <> 'log_event'
UNION ALL SELECT src || '>' || dst, edge_type, minute_ts, weight FROM v_edges e WHERE edge_type <> 'calls' AND EXISTS (SELECT 1 FROM v_nodes x WHERE x.id = e.src AND x.minute_ts = e.minute_ts AND node_type <> 'log_event') AND EXISTS (SELECT 1 FROM v_nodes x WHERE x.id = e.dst AND x.minute_ts = e.minute_ts AND node_type <> 'log_event')"""


def summary(s: SparkSession, d: str) -> DataFrame:
    path = place(s, "summary")
    writers.summary_json(*tel.tkg(s, d), path)
    return s.read.schema("of string, node_type string, edge_type string, n long, type string").json(path).select("of", F.coalesce("type", "node_type", "edge_type").alias("type"), "n")


def graph_statistics(s: SparkSession, d: str) -> DataFrame:
    path = place(s, "statistics")
    writers.degree_statistics(*tel.tkg(s, d), path)
    return s.read.schema("n long, m long, density double").json(path).select("n", "m", F.round("density", 9).alias("density"))


def evaluation(s: SparkSession, d: str) -> DataFrame:
    path = place(s, "evaluation")
    writers.result_json(links.QUERIES["ag13_hits_mrr"][0](s, d), path)
    return s.read.schema("hits1 double, hits3 double, hits10 double, mrr double, n long").json(path)


def stored(s: SparkSession, d: str) -> tuple[str, DataFrame, DataFrame]:
    """A store of the first half of the minutes, then brought up to date with all of them."""
    nodes, edges = (cut(x, "graph") for x in tel.tkg(s, d, False))
    folder = place(s, "store")
    store.merge(nodes.filter(F.col("minute_ts") <= tel.MID), edges.filter(F.col("minute_ts") <= tel.MID), folder)
    store.merge(nodes, edges, folder)
    return folder, nodes, edges


def store_window(s: SparkSession, d: str) -> DataFrame:
    n, e = store.window(s, stored(s, d)[0], tel.MID, 600)
    return n.select("id", "node_type", "minute_ts").unionByName(e.select(F.concat_ws(">", "src", "dst").alias("id"), F.col("edge_type").alias("node_type"), "minute_ts"))


#: Rows of a file of problems, which one task reads.
PER_FILE = 500_000


def instructions(s: SparkSession, d: str) -> DataFrame:
    """Problem texts and the windows that they name, a problem for each order's first line of text."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = b.read(s, d, "orders").select("o_orderkey", F.concat(F.lit("On "), day, F.lit(' the "shop", said,\nfailed between 10:00 and 10:30')).alias("instruction"), F.lit("x").alias("scoring_points"))
    path = out(rows.orderBy("o_orderkey").select("instruction", "scoring_points"), "problems", "csv", maxRecordsPerFile=PER_FILE, **TEXT)
    read = readers.problems(s, path, 1 << 30)
    return read.select(F.col("row_no").cast("long").alias("row_no"), times.window_in_text(F.col("instruction"))["start"].alias("start"))


QUERIES: dict = {
    "src1_metric_csv": (metric_csv, sql("SELECT t AS time, service, metric, value FROM v_metrics", "v_metrics")),
    "src2_metric_rows": (lambda s, d: metric_text(s, d, False), sql("SELECT t, service, metric, value FROM v_metrics WHERE t % 5 <> 0", "v_metrics")),
    "src3_metric_nan": (
        lambda s, d: metric_text(s, d, True).groupBy("service", "metric").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan("value")).alias("bad")),
        sql("SELECT service, metric, count(*) AS n, count(*) FILTER (WHERE t % 5 = 0) AS bad FROM v_metrics GROUP BY 1, 2", "v_metrics"),
    ),
    "src5_log_csv": (log_csv, sql(f"SELECT t AS time, service, CASE level WHEN 'WARN' THEN 'UNKNOWN' ELSE level END AS level, message FROM v_logs WHERE t BETWEEN {TARGET_FROM} AND {TARGET_TO}", "v_logs")),
    "src6_log_lines": (
        log_lines,
        "SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t, 'svc' || CAST(user_id % 20 AS VARCHAR) AS service, CASE event_id % 3 WHEN 0 THEN 'WARN' WHEN 1 THEN CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'UNKNOWN' END ELSE 'ERROR' END AS level, CASE WHEN event_id % 3 = 2 THEN 'plain ' || event_type ELSE event_type END AS message, count(*) AS n FROM events GROUP BY ALL",
    ),
    "src7_span_csv": (span_csv, sql(_SPANS, "v_spans")),
    "src8_span_export": (lambda s, d: span_json(s, d, True), sql(_SPANS, "v_spans")),
    "src9_span_list": (lambda s, d: span_json(s, d, False), sql(_SPANS, "v_spans")),
    "src10_problems": (instructions, "SELECT row_no, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + 36000 - 28800 AS start FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no FROM orders) WHERE row_no >= 1"),
    "src13_named_quads": (
        named_quads,
        sql("SELECT s.i::INTEGER AS s, r, o.i::INTEGER AS o, t FROM v_quads q JOIN v_n s ON s.id = q.s JOIN v_n o ON o.id = q.o", "v_quads", more="v_n AS (SELECT id, row_number() OVER (ORDER BY lpad(id::VARCHAR, 8, '0')) - 1 AS i FROM (SELECT s AS id FROM v_quads UNION SELECT o FROM v_quads))"),
    ),
    "src14_triples": (lambda s, d: triples(s, d).select(F.col("subject").cast("int").alias("s"), F.col("relation").cast("int").alias("r"), F.col("object").cast("int").alias("o")), sql("SELECT DISTINCT s, r, o FROM v_quads", "v_quads")),
    "src14_sampled_triples": (
        lambda s, d: triples(s, d, exactly=500).join(b.quads(s, d).select(*[F.col(c).cast("string").alias(n) for c, n in (("s", "subject"), ("r", "relation"), ("o", "object"))]).distinct(), ["subject", "relation", "object"]).agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT least(500, count(*)) AS n FROM (SELECT DISTINCT s, r, o FROM v_quads)", "v_quads"),
    ),
    "src15_names": (names, "SELECT p_name AS name, CAST(row_number() OVER (ORDER BY p_name) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT p_name FROM part)"),
    "src16_name_map": (name_map, "SELECT s_name AS name, CAST(s_suppkey AS INTEGER) AS id FROM supplier"),
    "src17_path_lines": (path_lines, sql("SELECT n0, n1, n2 FROM v_p", *causes.V, more=causes._PATHS)),
    "src18_candidates": (scored, sql("SELECT query_id, cand, round(score, 6) AS score FROM v_cands", "v_quads", "v_test", more=links._APPLIED)),
    "src21_rules": (lambda s, d: rule_files(s, d, "json"), sql("SELECT head_rel, b0 || ',' || b1 AS body, conf, rule_supp, body_supp FROM v_rules", "v_train", more=links._RULES)),
    "snk7_rule_texts": (lambda s, d: rule_files(s, d, "text"), sql("SELECT rule FROM v_text", "v_train", more=_TEXT)),
    "snk7_rules_by_head": (lambda s, d: rule_files(s, d, "heads"), sql("SELECT head_rel, rule FROM v_text", "v_train", more=_TEXT)),
    "snk1_graph_csv": (lambda s, d: graph_csv(s, d, False), sql(_BOTH, *tel.GRAPH, more=tel.NODES)),
    "snk4_trimmed_csv": (lambda s, d: graph_csv(s, d, True), sql(_TRIMMED, *tel.GRAPH, more=tel.NODES)),
    "snk3_summary": (summary, sql("SELECT 'nodes' AS of, node_type AS type, count(*) AS n FROM v_nodes GROUP BY 2 UNION ALL SELECT 'edges', edge_type, count(*) FROM v_edges GROUP BY 2", *tel.GRAPH, more=tel.NODES)),
    "snk11_statistics": (graph_statistics, sql("SELECT n, m, round(m / (n * (n - 1)), 9) AS density FROM (SELECT count(DISTINCT id) AS n FROM v_nodes), (SELECT count(*) AS m FROM v_edges)", *tel.GRAPH, more=tel.NODES)),
    "snk9_evaluation": (evaluation, links.QUERIES["ag13_hits_mrr"][1]),
    "snk5_minute_store": (store_window, sql(f"SELECT id, node_type, minute_ts FROM v_nodes WHERE minute_ts BETWEEN {tel.MID - 36000} AND {tel.MID + 36000} UNION ALL SELECT src || '>' || dst, edge_type, minute_ts FROM v_edges WHERE minute_ts BETWEEN {tel.MID - 36000} AND {tel.MID + 36000}", "v_events", more=tel.QUIET)),
    "snk5_manifest": (
        lambda s, d: store.manifest(s, stored(s, d)[0]).select("minute_ts", "nodes_count", "edges_count"),
        sql("SELECT minute_ts, coalesce(nodes_count, 0) AS nodes_count, coalesce(edges_count, 0) AS edges_count FROM (SELECT minute_ts, count(*) AS nodes_count FROM v_nodes GROUP BY 1) FULL JOIN (SELECT minute_ts, count(*) AS edges_count FROM v_edges GROUP BY 1) USING (minute_ts)", "v_events", more=tel.QUIET),
    ),
    "grf28_capped": (
        lambda s, d: quads.hop_neighbourhood(b.quads(s, d), s.createDataFrame([(1,)], "id int"), 2, cap=25).groupBy("hop").agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT CAST(hop AS INTEGER) AS hop, least(n, CASE WHEN hop = 0 THEN 1 ELSE 25 END) AS n FROM (SELECT 0 AS hop, 1 AS n UNION ALL SELECT 1, count(DISTINCT b) FROM v_b WHERE a = 1 UNION ALL SELECT 2, 25)", "v_quads", more="v_b AS (SELECT DISTINCT s AS a, o AS b FROM v_quads UNION SELECT o, s FROM v_quads)"),
    ),
}

