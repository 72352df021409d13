"""Queries over incident graphs: rankings, walks and root causes. name -> (query, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.operators import graph, problems, ranking, rca, walks
from faultloom.plans import telemetry as tel
from faultloom.plans.bindings import TARGET_TO, sql
from faultloom.sources.shared import cut

V = ("v_events", "v_traced")
QUIET = tel.QUIET


def small(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The incident graph of events alone, with precedes edges over all minutes of a service."""
    e = tel.events(s, d)
    nodes = graph.tkg_nodes(e, tel.no_calls(s))
    owned = graph.tkg_edges(e, tel.no_calls(s)).filter("edge_type <> 'precedes'")
    before = graph.chained(e, "service").select("src", "dst", F.lit("precedes").alias("edge_type"), F.lit(1.0).alias("weight"), "dt_seconds", "minute_ts")
    return nodes, owned.unionByName(before)


_SMALL = QUIET + """, v_se AS (
  SELECT src, dst, edge_type, dt_seconds, minute_ts FROM v_edges WHERE edge_type <> 'precedes'
  UNION ALL SELECT id, next, 'precedes', next_ts - event_ts, minute_ts FROM (SELECT minute_ts, id, event_ts, lead(id) OVER w AS next, lead(event_ts) OVER w AS next_ts FROM v_events WINDOW w AS (PARTITION BY service ORDER BY event_ts, kind, seq, id)) WHERE next IS NOT NULL)"""


def service_calls(s: SparkSession, d: str) -> DataFrame:
    """Distinct (src, dst): which services follow each other in traces."""
    name = lambda c: F.concat(F.lit("svc:"), c).alias(c)
    return tel.calls(s, d).select(name("src"), name("dst")).distinct()


_CALLS = "v_sc AS (SELECT DISTINCT 'svc:' || src AS src, 'svc:' || dst AS dst FROM v_traced)"


def scored(s: SparkSession, d: str) -> DataFrame:
    n, e = small(s, d)
    calls = service_calls(s, d).select("src", "dst", F.lit("calls").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit(None).cast("long").alias("dt_seconds"), F.lit(0).cast("long").alias("minute_ts"))
    return ranking.component_scores(n, e.unionByName(calls))


_SCORES = (
    _SMALL + ", " + _CALLS
    + """, v_sn AS (SELECT DISTINCT id FROM v_nodes WHERE node_type = 'service'), v_scored AS (
  SELECT id, coalesce(s.n, 0)::DOUBLE AS self, coalesce(i.n, 0)::DOUBLE AS impact, coalesce(p.n, 0)::DOUBLE AS spread, coalesce(l.v, 0.0) AS latency,
    0.4 * coalesce(s.n, 0) + 0.3 * coalesce(i.n, 0) + 0.2 * coalesce(p.n, 0) + 0.1 * coalesce(l.v, 0.0) AS score
  FROM v_sn LEFT JOIN (SELECT src AS id, count(*) AS n FROM v_se WHERE edge_type IN ('has_log', 'has_metric') GROUP BY 1) s USING (id)
  LEFT JOIN (SELECT src AS id, count(*) AS n FROM v_sc GROUP BY 1) i USING (id)
  LEFT JOIN (SELECT src AS id, count(*) AS n FROM (SELECT src, dst FROM v_sc UNION SELECT a.src, b.dst FROM v_sc a JOIN v_sc b ON b.src = a.dst) GROUP BY 1) p USING (id)
  LEFT JOIN (SELECT o.src AS id, avg(e.dt_seconds) AS v FROM (SELECT DISTINCT src, dst FROM v_se WHERE edge_type IN ('has_log', 'has_metric')) o JOIN v_se e ON e.src = o.dst AND e.edge_type = 'precedes' GROUP BY 1) l USING (id))"""
)


def relation_edges(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges (s, o, t) with names as ids, and nodes: has_* and precedes at the time of the later end, calls at their minute."""
    n, e = small(s, d)
    at = n.filter("event_ts is not null").groupBy(F.col("id").alias("dst")).agg(F.min("event_ts").alias("t"))
    timed = e.join(at, "dst").select(F.col("src").alias("s"), F.col("dst").alias("o"), "t", (F.col("edge_type") == "precedes").alias("causal"))
    name = lambda c: F.concat(F.lit("svc:"), c)
    called = tel.calls(s, d).select(name("src").alias("s"), name("dst").alias("o"), F.col("minute_ts").alias("t"), F.lit(False).alias("causal"))
    return n, cut(timed.unionByName(called), "edges")


_REL = _SMALL + ", v_at AS (SELECT id, min(event_ts) AS t FROM v_nodes WHERE event_ts IS NOT NULL GROUP BY 1), v_r AS (SELECT src AS s, dst AS o, t, edge_type = 'precedes' AS causal FROM v_se JOIN v_at ON v_at.id = dst UNION ALL SELECT 'svc:' || src, 'svc:' || dst, minute_ts, false FROM v_traced)"


def starts(n: DataFrame) -> DataFrame:
    return n.filter("node_type = 'metric_event'").select("id").distinct()


def features(s: SparkSession, d: str) -> DataFrame:
    n, e = relation_edges(s, d)
    services = n.filter("node_type = 'service'").select("id").distinct()
    return walks.walk_features(e, starts(n), services)


def service_reach(s: SparkSession, d: str) -> DataFrame:
    n, e = relation_edges(s, d)
    back = e.unionByName(e.select(F.col("o").alias("s"), F.col("s").alias("o"), "t", "causal"))
    n = cut(n.filter("node_type in ('service', 'metric_event')").select("id", "node_type").distinct(), "ends")  # read more than once
    calls = e.filter(F.col("o").startswith("svc:")).select("s", "o").distinct()  # only calls lead to a service
    return walks.reach_of_services(back, starts(n), n.filter("node_type = 'service'").select("id"), calls)


_WALKS = _REL + """, v_start AS (SELECT DISTINCT id FROM v_nodes WHERE node_type = 'metric_event'),
v_w AS (SELECT id AS start, 0 AS hop, id AS node, -1 AS t FROM v_start
 UNION ALL SELECT id, 1, a.o, a.t FROM v_start JOIN v_r a ON a.s = id
 UNION ALL SELECT id, 2, b.o, b.t FROM v_start JOIN v_r a ON a.s = id JOIN v_r b ON b.s = a.o AND b.t >= a.t
 UNION ALL SELECT id, 3, c.o, c.t FROM v_start JOIN v_r a ON a.s = id JOIN v_r b ON b.s = a.o AND b.t >= a.t JOIN v_r c ON c.s = b.o AND c.t >= b.t)"""


def seeds_and_causes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n, e = relation_edges(s, d)
    seeds = n.filter("node_type = 'log_event'").groupBy("service").agg(F.max_by(F.struct("id", F.col("event_ts").alias("t")), F.struct("event_ts", "id")).alias("x")).select("x.*")
    causes = n.filter(walks.is_root_cause()).select("id")
    return e, seeds, causes


def backwards(s: SparkSession, d: str, causal: bool = False) -> DataFrame:
    return walks.causes_back_in_time(*seeds_and_causes(s, d), causal_first=causal)


_BACK = _REL + """, v_seed AS (SELECT arg_max(id, (event_ts, id)) AS seed, max(event_ts) AS t FROM v_nodes WHERE node_type = 'log_event' GROUP BY service),
v_cause AS (SELECT DISTINCT id FROM v_nodes WHERE node_type = 'service' OR (node_type = 'metric_event' AND abs(zscore) > 2)),
v_h1 AS (SELECT seed, r.s AS node, max(r.t) AS t FROM v_seed d JOIN v_r r ON r.o = seed AND r.t <= d.t AND r.s <> seed GROUP BY 1, 2),
v_h2 AS (SELECT seed, r.s AS node, max(r.t) AS t FROM v_h1 h JOIN v_r r ON r.o = h.node AND r.t <= h.t WHERE r.s <> seed AND NOT EXISTS (SELECT 1 FROM v_h1 x WHERE x.seed = h.seed AND x.node = r.s) GROUP BY 1, 2),
v_h3 AS (SELECT seed, r.s AS node, max(r.t) AS t FROM v_h2 h JOIN v_r r ON r.o = h.node AND r.t <= h.t WHERE r.s <> seed AND NOT EXISTS (SELECT 1 FROM v_h1 x WHERE x.seed = h.seed AND x.node = r.s) AND NOT EXISTS (SELECT 1 FROM v_h2 x WHERE x.seed = h.seed AND x.node = r.s) GROUP BY 1, 2),
v_found AS (SELECT seed, node AS cause, hop, 1.0 / (hop + 1) AS confidence FROM (SELECT *, 1 AS hop FROM v_h1 UNION ALL SELECT *, 2 FROM v_h2 UNION ALL SELECT *, 3 FROM v_h3) JOIN v_cause ON id = node)"""


def paths(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All paths service -> event -> next event of the incident graph, numbered by their text."""
    n, e = small(s, d)
    e = cut(e, "small")
    owned, before = e.filter("edge_type <> 'precedes'"), e.filter("edge_type = 'precedes'")
    p = owned.select("src", "dst").join(before.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").distinct()
    p = p.select(F.concat_ws(">", "src", "dst", "far").alias("path_id"), F.array("src", "dst", "far").alias("path"))
    return p, n, e


_PATHS = _SMALL + """, v_p AS (SELECT DISTINCT a.src || '>' || a.dst || '>' || b.dst AS path_id, a.src AS n0, a.dst AS n1, b.dst AS n2 FROM v_se a JOIN v_se b ON b.src = a.dst AND b.edge_type = 'precedes' WHERE a.edge_type <> 'precedes'),
v_one AS (SELECT id, min(node_type) AS node_type, min(service) AS service, min(coalesce(event_ts, minute_ts)) AS at_, max(abs(coalesce(zscore, 0.0))) AS z FROM v_nodes GROUP BY 1),
v_step AS (SELECT n0 AS src, n1 AS dst FROM v_p UNION ALL SELECT n1, n2 FROM v_p),
v_e1 AS (SELECT src, dst, min(edge_type) AS edge_type FROM v_se GROUP BY 1, 2),
v_pat AS (SELECT a.node_type AS src_type, edge_type, b.node_type AS dst_type, count(*) AS support FROM v_step JOIN v_e1 USING (src, dst) JOIN v_one a ON a.id = src JOIN v_one b ON b.id = dst GROUP BY 1, 2, 3),
v_pats AS (SELECT *, support / sum(support) OVER () AS confidence FROM v_pat),
v_visit AS (SELECT unnest([n0, n1, n2]) AS id FROM v_p),
v_svc AS (SELECT service, count(*) FILTER (WHERE node_type = 'service') AS service_count, count(*) FILTER (WHERE node_type <> 'service') AS event_count, min(at_) AS min_time, avg(z) AS avg_zscore FROM v_visit JOIN v_one USING (id) GROUP BY 1)"""
_SCORED = f", v_scs AS (SELECT *, 0.3 * service_count + 0.4 * event_count + 0.2 * (1.0 / (1.0 + ({TARGET_TO} - min_time) / 60.0)) + 0.1 * avg_zscore AS score, service_count + event_count AS total FROM v_svc)"


def services_on_paths(s: SparkSession, d: str) -> DataFrame:
    p, n, _ = paths(s, d)
    return rca.score_services(p, n, TARGET_TO)


def _walk(s: SparkSession, d: str) -> DataFrame:
    n, e = small(s, d)
    return walks.random_walks(rca.with_types(n, e), n.filter("node_type = 'service'").select("id").distinct())


def _loop(s: SparkSession, d: str) -> DataFrame:
    n, e = small(s, d)
    n, e = cut(n, "nodes"), cut(e, "edges")
    start = rca.start_node(n).first()
    return rca.find_root_cause(n, e, start["minute_ts"], f"svc:{start['service']}", minutes=600)


def all_problems(s: SparkSession, d: str) -> DataFrame:
    """A problem for each service with errors; its text names the time of the first one for every other service."""
    first = tel.errors(s, d).groupBy("service").agg(F.min("t").alias("t"))
    at = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("t").cast("decimal(18,6)"))
    told = F.concat(F.lit("On "), F.date_format(at, "yyyy-MM-dd"), F.lit(" at "), F.date_format(at, "HH:mm"), F.lit(" errors began in "), "service")
    return first.select(F.col("service").alias("problem"), F.when(F.substr("service", F.lit(4)).cast("int") % 2 == 1, told).otherwise(F.concat(F.lit("What is wrong with "), "service")).alias("instruction"))


def _chosen(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n, e = small(s, d)
    n, e = cut(n, "nodes"), cut(e, "edges")
    return n, e, problems.chosen(all_problems(s, d), n, minutes=600, offset_hours=0)


def _all_causes(s: SparkSession, d: str) -> DataFrame:
    n, e, asked = _chosen(s, d)
    return problems.find_root_causes(n, e, asked, minutes=600)


_ASKED = QUIET + """, v_first AS (SELECT service AS problem, min(t) AS t FROM v_errors GROUP BY 1),
v_median AS (SELECT minute_ts FROM (SELECT minute_ts, row_number() OVER (ORDER BY minute_ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT minute_ts FROM v_nodes)) WHERE i = floor(n / 2)),
v_asked AS (SELECT problem, CASE WHEN substr(problem, 4)::INTEGER % 2 = 1 THEN t - t % 60 ELSE (SELECT minute_ts FROM v_median) END AS center, CASE WHEN substr(problem, 4)::INTEGER % 2 = 1 THEN 'text' ELSE 'median' END AS center_from FROM v_first),
v_metric AS (SELECT id, round(abs(zscore), 9) AS z, event_ts - event_ts % 60 AS minute FROM v_nodes WHERE node_type = 'metric_event'),
v_inside AS (SELECT problem, arg_min(id, (-z, id)) AS inside FROM v_asked JOIN v_metric ON minute BETWEEN center - 36000 AND center + 36000 GROUP BY 1)"""
_W2 = ", v_u AS (SELECT s, o, t FROM v_r UNION ALL SELECT o, s, t FROM v_r), v_w2 AS (SELECT id AS start, 0 AS hop, id AS node FROM v_start UNION ALL SELECT id, 1, a.o FROM v_start JOIN v_u a ON a.s = id UNION ALL SELECT id, 2, b.o FROM v_start JOIN v_u a ON a.s = id JOIN v_u b ON b.s = a.o AND b.t >= a.t)"
_FUSE = _SCORES + _REL[len(_SMALL):] + ", v_start AS (SELECT DISTINCT id FROM v_nodes WHERE node_type = 'metric_event')" + _W2


def r6(*cs):
    return [F.round(c, 6).alias(c) for c in cs]


QUERIES: dict = {
    "ag16_component_scores": (lambda s, d: scored(s, d).select("id", "self", "impact", "spread", *r6("latency", "score")), sql("SELECT id, self, impact, spread, round(latency, 6) AS latency, round(score, 6) AS score FROM v_scored", *V, more=_SCORES)),
    "tk8_ranked_services": (lambda s, d: ranking.ranked(scored(s, d).withColumn("score", F.round("score", 6))).select("id", "rank"), sql("SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM v_scored", *V, more=_SCORES)),
    "wn9_next_candidate": (
        lambda s, d: ranking.pick_next(scored(s, d).withColumn("score", F.round("score", 6))).select("id", *r6("gap")),
        sql("SELECT id, round(gap, 6) AS gap FROM (SELECT id, place, score - lead(score) OVER (ORDER BY place) AS gap FROM (SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS place FROM v_scored) WHERE place <= 5) ORDER BY gap DESC NULLS LAST, place LIMIT 1", *V, more=_SCORES),
    ),
    "grf41_rerank": (lambda s, d: ranking.rerank(scored(s, d), "svc:svc3", 0.9).select("id", *r6("score")), sql("SELECT id, round(score + CASE WHEN id = 'svc:svc3' THEN (0.9 - 0.5) * 0.5 ELSE 0 END, 6) AS score FROM v_scored", *V, more=_SCORES)),
    "ag17_walk_features": (
        lambda s, d: features(s, d).select("id", "path_count", "unique_reach", "last_ts_span", *r6("service_reachability", "avg_path_length")),
        sql("SELECT start AS id, count(*) FILTER (WHERE hop > 0)::DOUBLE AS path_count, count(DISTINCT node)::DOUBLE AS unique_reach, greatest(max(t), 0)::DOUBLE AS last_ts_span, round(count(DISTINCT CASE WHEN node IN (SELECT id FROM v_nodes WHERE node_type = 'service') THEN node END) / (SELECT count(DISTINCT id) FROM v_nodes WHERE node_type = 'service'), 6) AS service_reachability, round(coalesce(sum(hop) / nullif(count(*) FILTER (WHERE hop > 0), 0), 0.0), 6) AS avg_path_length FROM v_w GROUP BY 1", *V, more=_WALKS),
    ),
    "grf9_walk_counts": (
        lambda s, d: (lambda n_e: walks.enumerate_walks(n_e[1], starts(n_e[0]), 3))(relation_edges(s, d)).groupBy("start", "hop").agg(F.sum("ways").alias("ways")),
        sql("SELECT start, CAST(hop AS INTEGER) AS hop, count(*) AS ways FROM v_w GROUP BY 1, 2", *V, more=_WALKS),
    ),
    "grf10_service_reach": (
        lambda s, d: service_reach(s, d).select("id", "path_count", *r6("service_reachability", "avg_path_length"), "service_connections"),
        sql(
            "SELECT x.id, coalesce(n, 0)::DOUBLE AS path_count, round(coalesce(n, 0) / (SELECT count(*) FROM v_start), 6) AS service_reachability, round(coalesce(depth, 0.0), 6) AS avg_path_length, coalesce(c, 0)::DOUBLE AS service_connections FROM (SELECT DISTINCT id FROM v_nodes WHERE node_type = 'service') x LEFT JOIN (SELECT node AS id, count(*) AS n, avg(depth) AS depth FROM (SELECT start, node, min(hop) AS depth FROM v_w2 GROUP BY 1, 2) GROUP BY 1) y ON y.id = x.id LEFT JOIN (SELECT src AS id, count(*) AS c FROM v_sc WHERE dst IN (SELECT id FROM v_nodes WHERE node_type = 'service') GROUP BY 1) z ON z.id = x.id",
            *V, more=_WALKS + ", " + _CALLS + _W2,
        ),
    ),
    "grf40_fusion": (
        lambda s, d: ranking.fuse(scored(s, d).withColumn("score", F.round("score", 6)), service_reach(s, d)).select("id", *r6("fusion_score")),
        sql(
            "SELECT id, round(0.6 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END + 0.4 * CASE WHEN top > 0 THEN walk / top ELSE walk END, 6) AS fusion_score FROM (SELECT *, min(score) OVER () AS lo, max(score) OVER () AS hi, max(walk) OVER () AS top FROM (SELECT x.id, round(x.score, 6) AS score, 0.2 * coalesce(y.n, 0) / (SELECT count(*) FROM v_start) + 0.2 * CASE WHEN coalesce(y.n, 0) > 0 THEN 1.0 ELSE 0.0 END + 0.3 * least(coalesce(z.c, 0) / 5.0, 1.0) AS walk FROM v_scored x LEFT JOIN (SELECT node AS id, count(DISTINCT start) AS n FROM v_w2 GROUP BY 1) y ON y.id = x.id LEFT JOIN (SELECT src AS id, count(*) AS c FROM v_sc WHERE dst IN (SELECT id FROM v_sn) GROUP BY 1) z ON z.id = x.id))",
            *V, more=_FUSE,
        ),
    ),
    "grf11_causes_back_in_time": (lambda s, d: backwards(s, d).select("seed", "cause", "hop", *r6("confidence")), sql("SELECT seed, cause, CAST(hop AS INTEGER) AS hop, round(confidence, 6) AS confidence FROM v_found", *V, more=_BACK)),
    "grf12_causal_first": (lambda s, d: backwards(s, d, True).select("seed", "cause", "hop", *r6("confidence")), None),
    "ag18_best_cause": (
        lambda s, d: walks.best_cause(backwards(s, d)).select("seed", "cause", "paths", *r6("total")),
        sql("SELECT seed, cause, paths, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(total, 9) DESC, cause) AS place FROM (SELECT seed, cause, count(*) AS paths, sum(confidence) AS total FROM v_found GROUP BY 1, 2)) WHERE place = 1", *V, more=_BACK),
    ),
    "ag25_cached_causes": (
        lambda s, d: walks.cached_causes(backwards(s, d)).select("seed", *r6("confidence"), F.array_join("causes", ",").alias("causes")),
        sql("SELECT seed, round(max(confidence), 6) AS confidence, string_agg(DISTINCT cause, ',' ORDER BY cause) AS causes FROM v_found GROUP BY 1", *V, more=_BACK),
    ),
    "grf13_upstream": (
        lambda s, d: walks.upstream(service_calls(s, d), s.createDataFrame([("svc:svc5",), ("svc:svc7",)], "service string"), 3),
        sql("SELECT seed, service, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT seed, src AS service, 1 AS hop FROM v_seeds JOIN v_sc ON dst = seed UNION ALL SELECT seed, b.src, 2 FROM v_seeds JOIN v_sc a ON a.dst = seed JOIN v_sc b ON b.dst = a.src UNION ALL SELECT seed, c.src, 3 FROM v_seeds JOIN v_sc a ON a.dst = seed JOIN v_sc b ON b.dst = a.src JOIN v_sc c ON c.dst = b.src) WHERE service <> seed GROUP BY 1, 2", *V, more=_CALLS + ", v_seeds AS (SELECT unnest(['svc:svc5', 'svc:svc7']) AS seed)"),
    ),
    "ag9_pattern_rules": (
        lambda s, d: rca.pattern_rules(*paths(s, d)).select("src_type", "edge_type", "dst_type", "support", *r6("confidence")),
        sql("SELECT src_type, edge_type, dst_type, support, round(confidence, 6) AS confidence FROM v_pats", *V, more=_PATHS),
    ),
    "grf21_pattern_bias": (
        lambda s, d: rca.rules_to_bias(rca.pattern_rules(*paths(s, d))).select("src_type", "edge_type", "dst_type", *r6("bias")),
        sql("SELECT src_type, edge_type, dst_type, round(least(greatest(1.0 + 0.3 * 0.5 * (support / max(support) OVER () + confidence), 0.7), 1.3), 6) AS bias FROM v_pats", *V, more=_PATHS),
    ),
    "ag10_service_scores": (
        lambda s, d: services_on_paths(s, d).select("service", "service_count", "event_count", "min_time", *r6("avg_zscore", "score", "confidence")),
        sql("SELECT service, service_count, event_count, min_time, round(avg_zscore, 6) AS avg_zscore, round(score, 6) AS score, round(least(score / 10, 1.0), 6) AS confidence FROM v_scs", *V, more=_PATHS + _SCORED),
    ),
    "grf22_best_root_cause": (
        lambda s, d: rca.best_root_cause(services_on_paths(s, d).withColumn("score", F.round("score", 6))).select("service", "reason", "time", *r6("confidence")),
        sql("SELECT service, CASE WHEN avg_zscore > 2 THEN 'metric_anomaly' WHEN total > 5 THEN 'service_failure' ELSE 'cascade_failure' END AS reason, min_time AS time, round(least(round(score, 6) / 10, 1.0), 6) AS confidence FROM v_scs ORDER BY round(score, 6) DESC, service LIMIT 1", *V, more=_PATHS + _SCORED),
    ),
    "tk7_start_node": (lambda s, d: rca.start_node(small(s, d)[0]).select("id", "service", *r6("zscore")), sql("SELECT id, service, round(zscore, 6) AS zscore FROM v_nodes WHERE zscore IS NOT NULL ORDER BY v_nodes.zscore DESC, id LIMIT 1", *V, more=QUIET)),
    "wn10_median_minute": (lambda s, d: rca.median_minute(small(s, d)[0]), sql("SELECT minute_ts FROM (SELECT minute_ts, row_number() OVER (ORDER BY minute_ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT minute_ts FROM v_nodes)) WHERE i = floor(n / 2)", *V, more=QUIET)),
    "prj3_readable_paths": (
        lambda s, d: (lambda x: rca.readable(x[0], x[1]).select("path_id", F.size("steps").alias("n"), F.element_at("steps", 3)["node_type"].alias("last")))(paths(s, d)),
        sql("SELECT path_id, CAST(3 AS INTEGER) AS n, node_type AS last FROM v_p JOIN v_one ON id = n2", *V, more=_PATHS),
    ),
    "grf19_random_walks": (_walk, None),
    "grf20_root_cause_loop": (_loop, None),
    "h18_seeds_and_centres": (
        lambda s, d: _chosen(s, d)[2],
        sql("SELECT problem, center, coalesce(inside, (SELECT arg_min(id, (-z, id)) FROM v_metric)) AS start, center_from, CASE WHEN inside IS NOT NULL THEN 'window' ELSE 'graph' END AS start_from FROM v_asked LEFT JOIN v_inside USING (problem)", *V, more=_ASKED),
    ),
    "llm11_all_problems": (_all_causes, None),
    "wn11_path_confidence": (
        lambda s, d: paths(s, d)[0].select("path_id", F.round(walks.path_confidence(F.transform("path", lambda x: F.length(x).cast("long")), F.size("path")), 6).alias("confidence")),
        sql("SELECT path_id, round(1.0 / 3 * CASE WHEN length(n1) < length(n0) THEN 0.5 ELSE 1 END * CASE WHEN length(n2) < length(n1) THEN 0.5 ELSE 1 END, 6) AS confidence FROM v_p", *V, more=_PATHS),
    ),
    "flt10_seed_event": (
        lambda s, d: walks.seed_events(small(s, d)[0]).select("service", "id"),
        sql("SELECT service, arg_min(id, (-round(abs(zscore), 9), id)) AS id FROM v_nodes WHERE node_type = 'metric_event' AND abs(zscore) > 2 GROUP BY 1", *V, more=QUIET),
    ),
    "flt10_seed_log": (
        lambda s, d: walks.seed_events(small(s, d)[0], "log").select("service", "id"),
        sql("SELECT service, min(id) AS id FROM v_nodes WHERE node_type = 'log_event' AND severity = 'ERROR' GROUP BY 1", *V, more=QUIET),
    ),
    "flt13_root_causes": (
        lambda s, d: small(s, d)[0].filter(walks.is_root_cause()).select("id").distinct(),
        sql("SELECT DISTINCT id FROM v_nodes WHERE node_type = 'service' OR (node_type = 'metric_event' AND abs(zscore) > 2)", *V, more=QUIET),
    ),
    "tk6_ranked_patterns": (
        lambda s, d: rca.ranked_patterns(rca.pattern_rules(*paths(s, d)), "product").select("src_type", "edge_type", "dst_type", "place"),
        sql("SELECT src_type, edge_type, dst_type, row_number() OVER (ORDER BY support * confidence DESC, src_type, edge_type, dst_type) AS place FROM v_pats", *V, more=_PATHS),
    ),
    "flt11_first_events": (lambda s, d: walks.first_events(small(s, d)[0]), sql("SELECT service, arg_min(id, (event_ts, id)) AS id FROM v_events GROUP BY 1", *V)),
    "grf38_causal_part": (lambda s, d: walks.causal_part(small(s, d)[1], ("precedes",)).select("src", "dst"), sql("SELECT src, dst FROM v_se WHERE edge_type = 'precedes'", *V, more=_SMALL)),
    "grf39_path_services": (
        lambda s, d: (lambda x: walks.path_services(x[0], x[1]).select("path_id", F.array_join("services", ",").alias("services"), *r6("share", "confidence")))(paths(s, d)),
        sql("SELECT path_id, n0 AS services, round(1.0 / 3, 6) AS share, round(1.0 / 9, 6) AS confidence FROM v_p", *V, more=_PATHS),
    ),
}
