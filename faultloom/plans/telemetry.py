"""Queries over telemetry: anomalies, per-minute graphs, and operators on graphs. name -> (query, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.functions.times import minute_bucket
from faultloom.operators import anomaly, causal, graph
from faultloom.plans import bindings as b
from faultloom.plans.bindings import BASE_FROM, TARGET_FROM, TARGET_TO, sql
from faultloom.sources.shared import cut


def anomalies(s: SparkSession, d: str) -> DataFrame:
    return anomaly.baseline_anomalies(b.metrics(s, d), BASE_FROM, TARGET_FROM, TARGET_TO)


def errors(s: SparkSession, d: str) -> DataFrame:
    return b.logs(s, d).filter((F.col("level") == "ERROR") & F.col("t").between(TARGET_FROM, TARGET_TO))


def events(s: SparkSession, d: str) -> DataFrame:
    return graph.log_events(errors(s, d)).unionByName(graph.metric_events(anomalies(s, d)))


def calls(s: SparkSession, d: str) -> DataFrame:
    return graph.trace_calls(b.spans(s, d))


def no_calls(s: SparkSession) -> DataFrame:
    return s.createDataFrame([], "minute_ts long, src string, dst string")


def tkg(s: SparkSession, d: str, with_calls: bool = True) -> tuple[DataFrame, DataFrame]:
    e, c = events(s, d), calls(s, d) if with_calls else no_calls(s)
    return graph.tkg_nodes(e, c), graph.tkg_edges(e, c)


NODES = """v_nodes AS (
  SELECT DISTINCT 'svc:' || service AS id, 'service' AS node_type, service, CAST(NULL AS VARCHAR) AS metric, CAST(NULL AS VARCHAR) AS severity,
         CAST(NULL AS DOUBLE) AS zscore, CAST(NULL AS BIGINT) AS event_ts, minute_ts
  FROM (SELECT minute_ts, service FROM v_events UNION SELECT minute_ts, src FROM v_calls UNION SELECT minute_ts, dst FROM v_calls)
  UNION ALL SELECT id, node_type, service, metric, severity, zscore, event_ts, minute_ts FROM v_events
), v_edges AS (
  SELECT DISTINCT src, dst, edge_type, 1.0::DOUBLE AS weight, dt_seconds, minute_ts FROM (
    SELECT 'svc:' || service AS src, id AS dst, CASE node_type WHEN 'log_event' THEN 'has_log' ELSE 'has_metric' END AS edge_type, CAST(NULL AS BIGINT) AS dt_seconds, minute_ts FROM v_events
    UNION ALL SELECT 'svc:' || src, 'svc:' || dst, 'calls', NULL, minute_ts FROM v_calls
    UNION ALL SELECT id, next, 'precedes', next_ts - event_ts, minute_ts FROM (
      SELECT minute_ts, id, event_ts, lead(id) OVER w AS next, lead(event_ts) OVER w AS next_ts FROM v_events WINDOW w AS (PARTITION BY minute_ts, service ORDER BY event_ts, kind, seq, id)) WHERE next IS NOT NULL)
)"""
GRAPH = ("v_events", "v_calls")
MID = (TARGET_FROM + TARGET_TO) // 2 // 60 * 60


def _pre(s, d):
    return graph.chained(events(s, d), "service").select("src", "dst", "dt_seconds")


def _span_calls(s, d):
    spans = b.spans(s, d)
    named = lambda seq: F.concat_ws("-", F.col("trace_id").cast("string"), seq.cast("string"))
    rows = spans.select("trace_id", named(F.col("seq")).alias("span_id"), F.when(F.col("seq") > 1, named(F.col("seq") - 1)).alias("parent_id"), "service", "seq")
    return graph.span_calls(rows)


def _upsert(s, d):
    rows = b.logs(s, d).select("service", "level", "message", "seq")
    return graph.upsert(rows, ["service", "level"]).select("service", "level", "message", "seq")


def _trim(s, d):
    n, e = graph.trim(*tkg(s, d), drop_nodes=("log_event",), drop_edges=("calls",))
    return e.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")).unionByName(n.groupBy(F.col("node_type").alias("edge_type")).agg(F.count(F.lit(1)).alias("n")))


def _window(s, d):
    n, e = graph.window_subgraph(*tkg(s, d), center=MID, minutes=600)
    return n.select("id", "node_type", "minute_ts").unionByName(e.select(F.concat_ws(">", "src", "dst").alias("id"), F.col("edge_type").alias("node_type"), "minute_ts"))


def _edge_times(s, d):
    n, e = tkg(s, d)
    return graph.edge_times(n, e.filter("edge_type = 'precedes'")).select("src", "dst", "src_ts", "dst_ts", "event_ts")


def _ids(s, d):
    return graph.node_ids(tkg(s, d)[0])


def _relations(s, d):
    n, e = (cut(x, "graph") for x in tkg(s, d))
    timed = graph.edge_times(n, e)
    return graph.relation_edges(timed, {"has_log": 0, "has_metric": 1, "precedes": 2, "calls": 3}, graph.node_ids(n))


def _components(s, d):
    n, e = (cut(x, "graph") for x in tkg(s, d))
    return graph.weak_components(n, e).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def _state(s, d):
    state = anomaly.service_state(b.logs(s, d), b.metrics(s, d))
    critical = anomaly.critical_state(F.col("error_count"), F.get_json_object(F.to_json("metrics"), "$.click").cast("double"), F.lit(None).cast("double"))
    return state.select("service", "error_count", "last_error", critical.alias("critical"))


def _top(s, d):
    return anomaly.top_anomaly(anomaly.scored(b.metrics(s, d), BASE_FROM, TARGET_FROM, TARGET_TO)).select("t", "service", "metric", F.round("abs_z", 6).alias("abs_z"))


IDS = "v_ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS int_id FROM (SELECT DISTINCT id FROM v_nodes))"
_empty_calls = "v_calls AS (SELECT CAST(NULL AS BIGINT) AS minute_ts, CAST(NULL AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS dst WHERE false)"
QUIET = f"{_empty_calls}, {NODES}"
Z = lambda c="zscore": f"round({c}, 6) AS {c}"

QUERIES: dict = {
    "flt1_window_filter": (lambda s, d: b.metrics(s, d).filter(F.col("t").between(TARGET_FROM, TARGET_TO)), sql(f"SELECT * FROM v_metrics WHERE t BETWEEN {TARGET_FROM} AND {TARGET_TO}", "v_metrics")),
    "flt2_window_or_null": (
        lambda s, d: b.metrics(s, d).withColumn("t", F.when(F.col("t") % 7 != 0, F.col("t"))).filter(F.col("t").isNull() | F.col("t").between(TARGET_FROM, TARGET_TO)),
        sql(f"SELECT * FROM (SELECT CASE WHEN t % 7 <> 0 THEN t END AS t, service, metric, value FROM v_metrics) WHERE t IS NULL OR t BETWEEN {TARGET_FROM} AND {TARGET_TO}", "v_metrics"),
    ),
    "ag1_baseline_zscore": (lambda s, d: anomalies(s, d).select("t", "service", "metric", "value", F.round("zscore", 6).alias("zscore")), sql(f"SELECT t, service, metric, value, {Z()} FROM v_anomalies", "v_anomalies")),
    "ag2_series_zscore": (
        lambda s, d: anomaly.series_anomalies(b.metrics(s, d)).select("t", "service", "metric", F.round("zscore", 6).alias("zscore")),
        sql(
            "SELECT t, service, metric, round((value - mean) / sd, 6) AS zscore FROM (SELECT *, avg(value) OVER w AS mean, CASE WHEN stddev_pop(value) OVER w = 0 THEN 1.0 ELSE stddev_pop(value) OVER w END AS sd, count(*) OVER w AS n FROM v_metrics WHERE isfinite(value) WINDOW w AS (PARTITION BY service, metric)) WHERE n >= 5 AND abs((value - mean) / sd) >= 2.0",
            "v_metrics",
        ),
    ),
    "ag3_top_anomaly": (_top, sql("SELECT t, service, metric, round(abs(zscore), 6) AS abs_z FROM v_anomalies ORDER BY abs(zscore) DESC, t, service, metric LIMIT 1", "v_anomalies")),
    "ag4_type_counts": (lambda s, d: graph.type_counts(tkg(s, d)[0], "node_type").unionByName(graph.type_counts(tkg(s, d)[1], "edge_type")), sql("SELECT node_type AS type, count(*) AS n FROM v_nodes GROUP BY 1 UNION ALL SELECT edge_type, count(*) FROM v_edges GROUP BY 1", *GRAPH, more=NODES)),
    "ag24_service_state": (
        _state,
        sql(
            "SELECT coalesce(e.service, m.service) AS service, coalesce(error_count, 0) AS error_count, last_error, coalesce(error_count, 0) > 5 OR coalesce(click, 0) > 80 AS critical FROM (SELECT service, count(*) AS error_count, arg_max(message, (t, seq)) AS last_error FROM v_logs WHERE level = 'ERROR' GROUP BY service) e FULL JOIN (SELECT service, arg_max(value, (t, value)) FILTER (WHERE metric = 'click') AS click FROM v_metrics GROUP BY service) m ON e.service = m.service",
            "v_logs", "v_metrics",
        ),
    ),
    "ag26_service_anomalies": (
        lambda s, d: graph.service_anomalies(*tkg(s, d)),
        sql(
            "SELECT service, coalesce(metric_events, 0) AS metric_events, coalesce(log_events, 0) AS log_events, coalesce(calls_out, 0) AS calls_out, coalesce(calls_in, 0) AS calls_in FROM (SELECT service, count(*) FILTER (WHERE node_type = 'metric_event') AS metric_events, count(*) FILTER (WHERE node_type = 'log_event') AS log_events FROM v_events GROUP BY 1) FULL JOIN (SELECT src AS service, count(*) AS calls_out FROM v_calls GROUP BY 1) USING (service) FULL JOIN (SELECT dst AS service, count(*) AS calls_in FROM v_calls GROUP BY 1) USING (service)",
            *GRAPH,
        ),
    ),
    "ag27_validation": (
        lambda s, d: graph.validate(*tkg(s, d)),
        sql(
            "SELECT * FROM (SELECT count(*) AS nodes, count(event_ts) AS timed_nodes, count(event_ts) FILTER (WHERE node_type = 'service') AS timed_services FROM v_nodes), (SELECT count(*) AS precedes, count(*) FILTER (WHERE a.ts < z.ts) AS forward, count(*) FILTER (WHERE a.ts <= z.ts) AS not_backward FROM v_edges e LEFT JOIN (SELECT minute_ts, id, min(event_ts) AS ts FROM v_nodes GROUP BY 1, 2) a ON a.id = e.src AND a.minute_ts = e.minute_ts LEFT JOIN (SELECT minute_ts, id, min(event_ts) AS ts FROM v_nodes GROUP BY 1, 2) z ON z.id = e.dst AND z.minute_ts = e.minute_ts WHERE edge_type = 'precedes')",
            *GRAPH, more=NODES,
        ),
    ),
    "ag30_minute_index": (
        lambda s, d: graph.index(*tkg(s, d)),
        sql("SELECT minute_ts, coalesce(nodes_count, 0) AS nodes_count, coalesce(edges_count, 0) AS edges_count FROM (SELECT minute_ts, count(*) AS nodes_count FROM v_nodes GROUP BY 1) FULL JOIN (SELECT minute_ts, count(*) AS edges_count FROM v_edges GROUP BY 1) USING (minute_ts)", *GRAPH, more=NODES),
    ),
    "grf2_minute_nodes": (lambda s, d: tkg(s, d)[0].withColumn("zscore", F.round("zscore", 6)), sql(f"SELECT id, node_type, service, metric, severity, {Z()}, event_ts, minute_ts FROM v_nodes", *GRAPH, more=NODES)),
    "grf2_minute_edges": (lambda s, d: tkg(s, d)[1], sql("SELECT * FROM v_edges", *GRAPH, more=NODES)),
    "grf4_minute_bucket": (lambda s, d: b.metrics(s, d).groupBy(minute_bucket(F.col("t")).alias("minute_ts")).agg(F.count(F.lit(1)).alias("n")), sql("SELECT t - t % 60 AS minute_ts, count(*) AS n FROM v_metrics GROUP BY 1", "v_metrics")),
    "grf5_window_subgraph": (_window, sql(f"SELECT id, node_type, minute_ts FROM v_nodes WHERE minute_ts BETWEEN {MID - 36000} AND {MID + 36000} UNION ALL SELECT src || '>' || dst, edge_type, minute_ts FROM v_edges WHERE minute_ts BETWEEN {MID - 36000} AND {MID + 36000}", *GRAPH, more=NODES)),
    "grf6_degrees": (lambda s, d: graph.degrees(tkg(s, d)[1]), sql("SELECT id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM (SELECT src AS id, count(*) AS o FROM v_edges GROUP BY 1) FULL JOIN (SELECT dst AS id, count(*) AS i FROM v_edges GROUP BY 1) USING (id)", *GRAPH, more=NODES)),
    "grf6_density": (
        lambda s, d: graph.density(*tkg(s, d)).select("n", "m", F.round("density", 9).alias("density")),
        sql("SELECT n, m, round(m / (n * (n - 1)), 9) AS density FROM (SELECT count(DISTINCT id) AS n FROM v_nodes), (SELECT count(*) AS m FROM v_edges)", *GRAPH, more=NODES),
    ),
    "grf6_weak_components": (
        _components,
        "WITH RECURSIVE " + sql("", *GRAPH, more=f"{NODES}, pairs AS (SELECT DISTINCT src AS id, dst AS other FROM v_edges UNION SELECT dst, src FROM v_edges), reach(id, other) AS (SELECT id, id FROM v_nodes UNION SELECT r.id, p.other FROM reach r JOIN pairs p ON r.other = p.id)").removeprefix("WITH ")
        + "SELECT component, count(*) AS n FROM (SELECT id, min(other) AS component FROM reach GROUP BY id) GROUP BY 1",
    ),
    "grf7_minutes": (lambda s, d: tkg(s, d)[0].select("minute_ts").distinct(), sql("SELECT DISTINCT minute_ts FROM v_nodes", *GRAPH, more=NODES)),
    "grf8_node_ids": (_ids, sql("SELECT * FROM v_ids", *GRAPH, more=f"{NODES}, {IDS}")),
    "grf8_relation_edges": (
        _relations,
        sql(
            "SELECT s.int_id AS s, CASE edge_type WHEN 'has_log' THEN 0 WHEN 'has_metric' THEN 1 WHEN 'precedes' THEN 2 ELSE 3 END AS r, o.int_id AS o, coalesce(least(a.ts, z.ts), 0) AS t FROM v_edges e JOIN v_ids s ON s.id = src JOIN v_ids o ON o.id = dst LEFT JOIN (SELECT minute_ts, id, min(event_ts) AS ts FROM v_nodes GROUP BY 1, 2) a ON a.id = e.src AND a.minute_ts = e.minute_ts LEFT JOIN (SELECT minute_ts, id, min(event_ts) AS ts FROM v_nodes GROUP BY 1, 2) z ON z.id = e.dst AND z.minute_ts = e.minute_ts",
            *GRAPH, more=f"{NODES}, {IDS}",
        ),
    ),
    "flt16_trim": (
        _trim,
        sql("SELECT edge_type, count(*) AS n FROM v_edges e WHERE edge_type <> 'calls' AND EXISTS (SELECT 1 FROM v_nodes x WHERE x.id = e.src AND x.minute_ts = e.minute_ts AND node_type <> 'log_event') AND EXISTS (SELECT 1 FROM v_nodes x WHERE x.id = e.dst AND x.minute_ts = e.minute_ts AND node_type <> 'log_event') GROUP BY 1 UNION ALL SELECT node_type, count(*) FROM v_nodes WHERE node_type <> 'log_event' GROUP BY 1", *GRAPH, more=NODES),
    ),
    "jn1_span_calls": (_span_calls, sql("SELECT DISTINCT p.service AS src, c.service AS dst FROM v_spans c JOIN v_spans p ON p.trace_id = c.trace_id AND p.seq = c.seq - 1 WHERE p.service <> c.service", "v_spans")),
    "jn13_edge_times": (
        _edge_times,
        sql("SELECT src, dst, a.ts AS src_ts, z.ts AS dst_ts, least(a.ts, z.ts) AS event_ts FROM v_edges e LEFT JOIN (SELECT minute_ts, id, min(event_ts) AS ts FROM v_nodes GROUP BY 1, 2) a ON a.id = e.src AND a.minute_ts = e.minute_ts LEFT JOIN (SELECT minute_ts, id, min(event_ts) AS ts FROM v_nodes GROUP BY 1, 2) z ON z.id = e.dst AND z.minute_ts = e.minute_ts WHERE edge_type = 'precedes'", *GRAPH, more=NODES),
    ),
    "set3_services": (lambda s, d: graph.services_of(b.metrics(s, d), b.logs(s, d), b.spans(s, d)), sql("SELECT service FROM v_metrics UNION SELECT service FROM v_logs UNION SELECT service FROM v_spans", "v_metrics", "v_logs", "v_spans")),
    "set9_upsert": (_upsert, sql("SELECT service, level, arg_max(message, seq) AS message, max(seq) AS seq FROM v_logs GROUP BY 1, 2", "v_logs")),
    "wn1_trace_calls": (lambda s, d: calls(s, d), sql("SELECT * FROM v_calls", "v_calls")),
    "wn2_precedes": (_pre, sql("SELECT id AS src, next AS dst, next_ts - event_ts AS dt_seconds FROM (SELECT id, event_ts, lead(id) OVER w AS next, lead(event_ts) OVER w AS next_ts FROM v_events WINDOW w AS (PARTITION BY service ORDER BY event_ts, kind, seq, id)) WHERE next IS NOT NULL", "v_events")),
    "wn3_minute_precedes": (
        lambda s, d: graph.precedes(events(s, d), "minute_ts", "service"),
        sql("SELECT minute_ts, id AS src, next AS dst, next_ts - event_ts AS dt_seconds FROM (SELECT minute_ts, id, event_ts, lead(id) OVER w AS next, lead(event_ts) OVER w AS next_ts FROM v_events WINDOW w AS (PARTITION BY minute_ts, service ORDER BY event_ts, kind, seq, id)) WHERE next IS NOT NULL", "v_events"),
    ),
    "flt12_recent_events": (lambda s, d: anomaly.recent(b.logs(s, d).filter("level = 'ERROR'"), TARGET_TO, 300_000).select("seq", "t"), sql(f"SELECT seq, t FROM v_logs WHERE level = 'ERROR' AND {TARGET_TO} - t <= 300000", "v_logs")),
    "h2_node_values": (
        lambda s, d: tkg(s, d)[0].select("id", graph.node_time().alias("at"), F.round(graph.node_z(), 6).alias("z")),
        sql("SELECT id, coalesce(event_ts, minute_ts) AS at, round(coalesce(zscore, 0.0), 6) AS z FROM v_nodes", *GRAPH, more=NODES),
    ),
}


STEP = 6 * 3600
#: The columns of the wide frame: every service and metric of the tables.
SERIES = [f"svc{k}|{metric}" for k in range(20) for metric in ("click", "error", "purchase", "signup", "view")]


def grid(s: SparkSession, d: str) -> DataFrame:
    return causal.resampled(causal.series_means(b.metrics(s, d)), STEP)


_MEANS = "v_means AS (SELECT t, service || '|' || metric AS series, avg(value) AS value FROM v_metrics GROUP BY 1, 2)"
_GRID = (
    _MEANS
    + f""", v_filled AS (SELECT t - t % {STEP} AS t, series, avg(value) AS value FROM v_means GROUP BY 1, 2),
v_grid AS (SELECT g.t, x.series, f.value FROM (SELECT unnest(range((SELECT min(t) FROM v_filled), (SELECT max(t) FROM v_filled) + 1, {STEP})) AS t) g
  CROSS JOIN (SELECT DISTINCT series FROM v_filled) x LEFT JOIN v_filled f ON f.t = g.t AND f.series = x.series)"""
)
_STATS = _GRID + ", v_stats AS (SELECT series, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM v_grid GROUP BY 1 HAVING count(value) > 0 AND stddev_pop(value) <> 0), v_std AS (SELECT t, series, coalesce((value - mean) / (sd + 1e-8), 0.0) AS value FROM v_grid JOIN v_stats USING (series))"

R6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


def _corr(s, d):
    return causal.correlations(causal.forward_backward(grid(s, d))).select("a", "b", *R6("corr"))


_FILL = "coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING), first_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"

QUERIES |= {
    "ag5_wide_means": (
        lambda s, d: causal.wide(causal.series_means(b.metrics(s, d)), SERIES).select("t", *[F.round(f"`{c}`", 6).alias(c) for c in SERIES]),
        sql("SELECT t, " + ", ".join(f"round(avg(value) FILTER (WHERE service || '|' || metric = '{c}'), 6) AS \"{c}\"" for c in SERIES) + " FROM v_metrics GROUP BY t", "v_metrics"),
    ),
    "ag6_resampled": (lambda s, d: grid(s, d).select("t", "series", *R6("value")), sql("SELECT t, series, round(value, 6) AS value FROM v_grid", "v_metrics", more=_GRID)),
    "wn4_fill": (lambda s, d: causal.forward_backward(grid(s, d)).select("t", "series", *R6("value")), sql(f"SELECT t, series, round({_FILL}, 6) AS value FROM v_grid", "v_metrics", more=_GRID)),
    "wn5_interpolate": (
        lambda s, d: causal.interpolated(grid(s, d)).select("t", "series", *R6("value")),
        sql(
            "SELECT t, series, round(coalesce(value, v0 + (v1 - v0) * (i - i0) / (i1 - i0), v0, v1), 6) AS value FROM (SELECT *, last_value(value IGNORE NULLS) OVER up AS v0, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER up AS i0, first_value(value IGNORE NULLS) OVER down AS v1, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER down AS i1 FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) AS i FROM v_grid) WINDOW up AS (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING), down AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
            "v_metrics", more=_GRID,
        ),
    ),
    "flt17_usable_series": (lambda s, d: causal.usable_series(grid(s, d)).select("series", "n", *R6("mean", "sd")), sql("SELECT series, n, round(mean, 6) AS mean, round(sd, 6) AS sd FROM v_stats", "v_metrics", more=_STATS)),
    "mt3_standardized": (lambda s, d: causal.standardized(grid(s, d)).select("t", "series", *R6("value")), sql("SELECT t, series, round(value, 6) AS value FROM v_std", "v_metrics", more=_STATS)),
    "grf33_correlations": (
        _corr,
        sql("SELECT a.series AS a, b.series AS b, round(corr(a.value, b.value), 6) AS corr FROM v_std a JOIN v_std b ON a.t = b.t AND a.series < b.series GROUP BY 1, 2", "v_metrics", more=_STATS.replace("FROM v_grid GROUP BY 1 HAVING", f"FROM v_gridf GROUP BY 1 HAVING").replace("FROM v_grid JOIN v_stats", "FROM v_gridf JOIN v_stats").replace(", v_stats AS", f", v_gridf AS (SELECT t, series, {_FILL} AS value FROM v_grid), v_stats AS")),
    ),
    "grf33_causal_edges": (lambda s, d: causal.causal_edges(causal.forward_backward(grid(s, d))), None),
}
