"""The driver tables in the shapes that the operators take, as DataFrames and as SQL views.

``VIEWS`` holds the SQL twin of each view, to be put before an oracle query by ``sql()``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"

# The baseline and target windows of the anomaly queries (epoch seconds), inclusive ends.
BASE_FROM, TARGET_FROM, TARGET_TO = 1_704_931_200, 1_705_795_200, 1_706_227_200
TRAIN_END, VALID_END = 2800, 3150


def epoch(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(SECOND, {EPOCH_NTZ}, {ts})")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metrics(spark: SparkSession, d: str) -> DataFrame:
    service = F.concat(F.lit("svc"), (F.col("user_id") % 20).cast("string"))
    return read(spark, d, "events").select(epoch("ts").alias("t"), service.alias("service"), F.col("event_type").alias("metric"), "value")


def logs(spark: SparkSession, d: str) -> DataFrame:
    from faultloom.functions.text import log_message

    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("UNKNOWN")
    service = F.concat(F.lit("svc"), (F.col("user_id") % 20).cast("string"))
    return read(spark, d, "events").select(
        epoch("ts").alias("t"), service.alias("service"), level.alias("level"), log_message(F.col("event_type"), F.col("props")).alias("message"), F.col("event_id").alias("seq")
    )


def spans(spark: SparkSession, d: str) -> DataFrame:
    """(trace_id, seq, service, t): the position in the trace names the span; its parent is the one before."""
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("trace_id"),
        F.row_number().over(order).cast("long").alias("seq"),
        F.concat(F.lit("svc"), (F.col("l_suppkey") % 20).cast("string")).alias("service"),
        epoch("l_shipdate").alias("t"),
    )


def quads(spark: SparkSession, d: str) -> DataFrame:
    """(s, r, o, t): customer, priority, supplier, days since 1992."""
    return lines(spark, d).distinct()


def entities(spark: SparkSession, d: str) -> DataFrame:
    """(id): the distinct ends of ``quads``."""
    return lines(spark, d).select(F.explode(F.array("s", "o")).alias("id")).distinct()


def lines(spark: SparkSession, d: str) -> DataFrame:
    """``quads``, of each line one: they may repeat."""
    from faultloom.operators.quads import dictionary, encode

    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.expr("CAST(datediff(o_orderdate, DATE'1992-01-01') AS INT)").alias("t"))
    coded = encode(orders, dictionary(orders, "o_orderpriority"), "o_orderpriority", "r")
    supplied = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    met = supplied.join(coded, F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select(F.col("o_custkey").cast("int").alias("s"), F.col("r").cast("int").alias("r"), (F.col("l_suppkey") + 1_000_000).cast("int").alias("o"), "t")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """(s, r, o, t): the quadruples and two more relations, on which bodies of all lengths close by themselves:
    5, a customer orders a part, and 6, a part is shipped by a supplier."""
    days = lambda c: F.expr(f"CAST(datediff({c}, DATE'1992-01-01') AS INT)").alias("t")
    lines = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") + 2_000_000).cast("int").alias("p"), (F.col("l_suppkey") + 1_000_000).cast("int").alias("o"), "l_shipdate")
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("s"), days("o_orderdate"))
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("s", F.lit(5).alias("r"), F.col("p").alias("o"), "t").distinct()
    shipped = lines.select(F.col("p").alias("s"), F.lit(6).alias("r"), "o", days("l_shipdate")).distinct()
    return quads(spark, d).unionByName(bought).unionByName(shipped)


def _ep(x: str) -> str:
    return f"CAST(floor(epoch({x})) AS BIGINT)"


VIEWS = {
    "v_metrics": f"SELECT {_ep('ts')} AS t, 'svc' || CAST(user_id % 20 AS VARCHAR) AS service, event_type AS metric, value FROM events",
    "v_logs": f"""SELECT {_ep('ts')} AS t, 'svc' || CAST(user_id % 20 AS VARCHAR) AS service,
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'UNKNOWN' END AS level,
        event_type || ': ' || coalesce(props, '') AS message, event_id AS seq FROM events""",
    "v_spans": f"""SELECT l_orderkey AS trace_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
        'svc' || CAST(l_suppkey % 20 AS VARCHAR) AS service, {_ep('l_shipdate')} AS t FROM lineitem""",
    "v_quads": """SELECT DISTINCT CAST(o_custkey AS INTEGER) AS s, CAST(p.r AS INTEGER) AS r, CAST(1000000 + l_suppkey AS INTEGER) AS o,
        CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS t
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN (SELECT o_orderpriority AS name, row_number() OVER (ORDER BY o_orderpriority) - 1 AS r FROM (SELECT DISTINCT o_orderpriority FROM orders)) p ON p.name = o_orderpriority""",
    "v_facts": """SELECT s, r, o, t FROM v_quads
        UNION ALL SELECT DISTINCT CAST(o_custkey AS INTEGER), 5, CAST(2000000 + l_partkey AS INTEGER), CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT DISTINCT CAST(2000000 + l_partkey AS INTEGER), 6, CAST(1000000 + l_suppkey AS INTEGER), CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) FROM lineitem""",
    "v_train": f"SELECT * FROM v_quads WHERE t < {TRAIN_END}",
    "v_valid": f"SELECT * FROM v_quads WHERE t >= {TRAIN_END} AND t < {VALID_END}",
    "v_test": f"SELECT * FROM v_quads WHERE t >= {VALID_END}",
    "v_anomalies": f"""SELECT m.t, m.service, m.metric, m.value, (m.value - b.mean) / b.sd AS zscore
        FROM v_metrics m JOIN (
          SELECT service, metric, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS sd
          FROM v_metrics WHERE t >= {BASE_FROM} AND t < {TARGET_FROM} AND isfinite(value) GROUP BY service, metric HAVING count(*) >= 5) b
        ON m.service = b.service AND m.metric = b.metric
        WHERE m.t BETWEEN {TARGET_FROM} AND {TARGET_TO} AND isfinite(m.value) AND abs((m.value - b.mean) / b.sd) >= 3""",
    "v_errors": f"SELECT * FROM v_logs WHERE level = 'ERROR' AND t BETWEEN {TARGET_FROM} AND {TARGET_TO}",
    "v_events": """SELECT 'log:' || service || ':' || CAST(seq AS VARCHAR) AS id, 'log_event' AS node_type, service, CAST(NULL AS VARCHAR) AS metric, level AS severity,
          CAST(NULL AS DOUBLE) AS zscore, t AS event_ts, t - t % 60 AS minute_ts, 0 AS kind, seq FROM v_errors
        UNION ALL SELECT 'met:' || service || ':' || metric || ':' || CAST(t AS VARCHAR), 'metric_event', service, metric, NULL, zscore, t, t - t % 60, 1, t
        FROM v_anomalies""",
    "v_calls": """SELECT DISTINCT t_next - t_next % 60 AS minute_ts, service AS src, s_next AS dst FROM (
          SELECT service, lead(service) OVER w AS s_next, lead(t) OVER w AS t_next FROM v_spans WINDOW w AS (PARTITION BY trace_id ORDER BY t, seq))
        WHERE s_next IS NOT NULL AND s_next <> service""",
}

VIEWS["v_traced"] = VIEWS["v_calls"]  # under a name that the graph of events alone doesn't redefine

_NEEDS = {
    "v_train": ["v_quads"], "v_valid": ["v_quads"], "v_test": ["v_quads"], "v_facts": ["v_quads"], "v_anomalies": ["v_metrics"], "v_errors": ["v_logs"],
    "v_events": ["v_errors", "v_anomalies"], "v_calls": ["v_spans"], "v_traced": ["v_spans"],
}


def sql(body: str, *views: str, more: str = "") -> str:
    """An oracle query over the views it names (and those they need); ``more`` holds further CTEs."""
    wanted: list[str] = []

    def add(v: str) -> None:
        for x in _NEEDS.get(v, []):
            add(x)
        if v not in wanted:
            wanted.append(v)

    for v in views:
        add(v)
    parts = [f"{v} AS ({VIEWS[v]})" for v in wanted] + ([more] if more else [])
    return (f"WITH {', '.join(parts)} " if parts else "") + body
