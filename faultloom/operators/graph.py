"""Temporal property graphs: per-minute nodes and edges from telemetry, and operators on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultloom.functions.attrs import beside
from faultloom.functions.times import minute_bucket
from faultloom.sources.shared import cut, numbered
from faultloom.schema import ALLOWED_EDGES, EDGE_COLUMNS, NODE_COLUMNS


def log_events(logs: DataFrame) -> DataFrame:
    """log_event nodes of log rows (t, service, level, seq)."""
    name = F.concat_ws(":", F.lit("log"), "service", F.col("seq").cast("string"))
    return logs.select(
        name.alias("id"), F.lit("log_event").alias("node_type"), "service", F.lit(None).cast("string").alias("metric"), F.col("level").alias("severity"),
        F.lit(None).cast("double").alias("zscore"), F.col("t").alias("event_ts"), minute_bucket(F.col("t")).alias("minute_ts"), F.lit(0).alias("kind"), F.col("seq").cast("long").alias("seq"),
    )


def metric_events(anomalies: DataFrame) -> DataFrame:
    """metric_event nodes of anomaly rows (t, service, metric, zscore)."""
    name = F.concat_ws(":", F.lit("met"), "service", "metric", F.col("t").cast("string"))
    return anomalies.select(
        name.alias("id"), F.lit("metric_event").alias("node_type"), "service", "metric", F.lit(None).cast("string").alias("severity"),
        "zscore", F.col("t").alias("event_ts"), minute_bucket(F.col("t")).alias("minute_ts"), F.lit(1).alias("kind"), F.col("t").cast("long").alias("seq"),
    )


def span_calls(spans: DataFrame) -> DataFrame:
    """Distinct (src, dst): service of a parent span calls that of its child; spans (trace_id, span_id,
    parent_id, service, seq); of repeated span ids the last by seq counts."""
    last = spans.groupBy("trace_id", "span_id").agg(F.max_by(F.struct("parent_id", "service"), "seq").alias("x"))
    last = last.select("trace_id", "span_id", "x.*")
    parent = last.select("trace_id", F.col("span_id").alias("parent_id"), F.col("service").alias("src"))
    found = last.join(parent, ["trace_id", "parent_id"]).filter("src <> service")
    return found.select("src", F.col("service").alias("dst")).distinct()


def trace_calls(spans: DataFrame) -> DataFrame:
    """Distinct (minute_ts, src, dst): neighbours in the time order of a trace, at the later one's minute."""
    w = Window.partitionBy("trace_id").orderBy("t", "seq")
    s = spans.select("service", F.lead("service").over(w).alias("next"), F.lead("t").over(w).alias("t_next"))
    s = s.filter("next is not null and next <> service")
    return s.select(minute_bucket(F.col("t_next")).alias("minute_ts"), F.col("service").alias("src"), F.col("next").alias("dst")).distinct()


def services_of(*frames: DataFrame) -> DataFrame:
    """Distinct services over all frames."""
    return reduce(DataFrame.union, [f.select("service") for f in frames]).filter("service is not null").distinct()


def tkg_nodes(events: DataFrame, calls: DataFrame) -> DataFrame:
    """All nodes of all minutes: events, and a service node for each service of the minute."""
    named = events.select("minute_ts", "service").union(calls.select("minute_ts", "src")).union(calls.select("minute_ts", "dst")).distinct()
    services = named.select(
        F.concat(F.lit("svc:"), F.col("service")).alias("id"), F.lit("service").alias("node_type"), "service", F.lit(None).cast("string").alias("metric"),
        F.lit(None).cast("string").alias("severity"), F.lit(None).cast("double").alias("zscore"), F.lit(None).cast("long").alias("event_ts"), "minute_ts",
    )
    return services.unionByName(events.select(*NODE_COLUMNS))


def precedes(events: DataFrame, *keys: str) -> DataFrame:
    """Edges from each event to the next of its group: by time, logs before metrics, then order of arrival."""
    w = Window.partitionBy(*keys).orderBy("event_ts", "kind", "seq", "id")
    pairs = events.select("minute_ts", F.col("id").alias("src"), F.lead("id").over(w).alias("dst"), (F.lead("event_ts").over(w) - F.col("event_ts")).alias("dt_seconds"))
    return pairs.filter("dst is not null")


def chained(events: DataFrame, *keys: str) -> DataFrame:
    """As ``precedes``, for groups of any size: no task holds a hot group.

    Ranges of (group, order) are joined up apart; a range's last event of a group is followed by the first of
    the group's next range, and only these, a row for each group and range, meet.
    """
    order = ["event_ts", "kind", "seq", "id"]
    ranged = cut(events.select("minute_ts", *[k for k in keys if k != "minute_ts"], *order).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    follow = F.struct(F.col("id").alias("dst"), F.col("event_ts").alias("dst_ts"))
    rows = ranged.withColumn("_next", F.lead(follow).over(within))
    first = ranged.groupBy(*keys, "_part").agg(F.min_by(follow, F.struct(*order)).alias("_first"))
    later = first.withColumn("_later", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_part"))).drop("_first").filter("_later is not null")
    last = rows.filter("_next is null").drop("_next").join(later, [*keys, "_part"]).withColumnRenamed("_later", "_next")
    joined = rows.filter("_next is not null").unionByName(last)
    return joined.select("minute_ts", F.col("id").alias("src"), "_next.dst", (F.col("_next.dst_ts") - F.col("event_ts")).alias("dt_seconds"))


def tkg_edges(events: DataFrame, calls: DataFrame) -> DataFrame:
    """All edges of all minutes (src, dst, edge_type, weight, dt_seconds, minute_ts)."""
    none = F.lit(None).cast("long")
    owned = events.select(
        F.concat(F.lit("svc:"), F.col("service")).alias("src"), F.col("id").alias("dst"), F.when(F.col("node_type") == "log_event", "has_log").otherwise("has_metric").alias("edge_type"), none.alias("dt_seconds"), "minute_ts"
    )
    called = calls.select(F.concat(F.lit("svc:"), "src").alias("src"), F.concat(F.lit("svc:"), "dst").alias("dst"), F.lit("calls").alias("edge_type"), none.alias("dt_seconds"), "minute_ts")
    before = precedes(events, "minute_ts", "service").withColumn("edge_type", F.lit("precedes"))
    every = owned.unionByName(called).unionByName(before)
    return every.withColumn("weight", F.lit(1.0)).select(*EDGE_COLUMNS).distinct()


def upsert(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row by ``seq`` for each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("x")).select(*keys, "x.*")


def trim(nodes: DataFrame, edges: DataFrame, drop_nodes: tuple[str, ...] = (), drop_edges: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Without some node and edge types; edges stay if both ends do."""
    kept = nodes.filter(~F.col("node_type").isin(*drop_nodes)) if drop_nodes else nodes
    ids = kept.select("minute_ts", "id").distinct()
    left = edges.filter(~F.col("edge_type").isin(*drop_edges)) if drop_edges else edges
    for end in ("src", "dst"):
        left = left.join(ids.withColumnRenamed("id", end), ["minute_ts", end], "left_semi")
    return kept, left.select(*edges.columns)


def window_subgraph(nodes: DataFrame, edges: DataFrame, center: int, minutes: int, allowed: tuple[str, ...] = ALLOWED_EDGES) -> tuple[DataFrame, DataFrame]:
    """Nodes and allowed edges with minute_ts in center -/+ minutes (seconds since 1970)."""
    inside = F.col("minute_ts").between(center - 60 * minutes, center + 60 * minutes)
    return nodes.filter(inside), edges.filter(inside & F.col("edge_type").isin(*allowed))


def index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per minute: number of nodes and edges."""
    n = nodes.groupBy("minute_ts").agg(F.count(F.lit(1)).alias("nodes_count"))
    e = edges.groupBy("minute_ts").agg(F.count(F.lit(1)).alias("edges_count"))
    return n.join(e, "minute_ts", "full_outer").select("minute_ts", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nodes_count", "edges_count")])


def type_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def edge_times(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the times of both ends and their own: the earlier of both."""
    at = nodes.filter("event_ts is not null").groupBy("minute_ts", "id").agg(F.min("event_ts").alias("ts"))
    for end in ("src", "dst"):
        edges = edges.join(at.select("minute_ts", F.col("id").alias(end), F.col("ts").alias(f"{end}_ts")), ["minute_ts", end], "left")
    return edges.withColumn("event_ts", F.least("src_ts", "dst_ts"))


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes by kind of time, and how many precedes edges run forward in time."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("event_ts").isNotNull()).alias("timed_nodes"), F.count_if((F.col("node_type") == "service") & F.col("event_ts").isNotNull()).alias("timed_services"))
    p = edge_times(nodes, edges.filter("edge_type = 'precedes'"))
    p = p.agg(F.count(F.lit(1)).alias("precedes"), F.count_if(F.col("src_ts") < F.col("dst_ts")).alias("forward"), F.count_if(F.col("src_ts") <= F.col("dst_ts")).alias("not_backward"))
    return beside(n, p)


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return out.join(into, "id", "full_outer").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("out_degree", "in_degree")])


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n, m and m / (n (n - 1))."""
    n = nodes.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    m = edges.agg(F.count(F.lit(1)).alias("m"))
    d = F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return beside(n, m).withColumn("density", d)


def weak_components(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id reached against or along edges, by label propagation with
    checkpoints in the shared folder between rounds; an error if they are too few."""
    from faultloom.sources.shared import cut

    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("id", "other").filter("id <> other").distinct()
    label = nodes.select("id").distinct().withColumn("component", F.col("id"))
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("near"))
        moved = label.join(near, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("next"), F.col("component").alias("was"))
        # Pointer jump: the label of one's label.
        jump = moved.select(F.col("id").alias("next"), F.col("next").alias("far"))
        moved = cut(moved.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("component"), "was"), "labels")
        label = moved.select("id", "component")
        if moved.filter("component <> was").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def node_ids(nodes: DataFrame) -> DataFrame:
    """(id, int_id): dense numbers from 0 in order of id."""
    return numbered(nodes.select("id").distinct(), "id", "int_id")


def relation_edges(edges: DataFrame, relations: dict[str, int], ids: DataFrame) -> DataFrame:
    """(s, r, o, t) with dense ids for the relations in the map; edges without time get 0."""
    name = F.col("edge_type")
    r = reduce(lambda c, kv: F.when(name == kv[0], kv[1]).otherwise(c), relations.items(), F.lit(None).cast("int"))
    found = edges.withColumn("r", r).filter("r is not null")
    a, b = ids.toDF("src", "s"), ids.toDF("dst", "o")
    return found.join(a, "src").join(b, "dst").select("s", "r", "o", F.coalesce(F.col("event_ts"), F.lit(0)).alias("t"))


def node_time() -> Column:
    return F.coalesce("event_ts", "minute_ts")


def node_z(column: str = "zscore") -> Column:
    z = F.col(column).try_cast("double")
    return F.when(z.isNull() | F.isnan(z), 0.0).otherwise(z)


def service_anomalies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per service: metric and log events, and calls out and in."""
    events = nodes.filter("node_type <> 'service'").groupBy("service").agg(
        F.count_if(F.col("node_type") == "metric_event").alias("metric_events"), F.count_if(F.col("node_type") == "log_event").alias("log_events")
    )
    calls = edges.filter("edge_type = 'calls'")
    name = lambda c: F.regexp_replace(c, "^svc:", "").alias("service")
    out = calls.groupBy(name("src")).agg(F.count(F.lit(1)).alias("calls_out"))
    into = calls.groupBy(name("dst")).agg(F.count(F.lit(1)).alias("calls_in"))
    joined = events.join(out, "service", "full_outer").join(into, "service", "full_outer")
    return joined.select("service", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("metric_events", "log_events", "calls_out", "calls_in")])
