"""Root causes from walks over a window graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultloom.operators import graph, walks
from faultloom.sources.shared import cut


def path_steps(paths: DataFrame) -> DataFrame:
    """(path_id, step, src, dst) of paths (path_id, path)."""
    pairs = F.transform(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))), lambda v, i: F.struct(F.get("path", i).alias("src"), v.alias("dst")))
    return paths.select("path_id", F.posexplode(pairs).alias("step", "x")).select("path_id", "step", "x.*")


def pattern_rules(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_type, edge_type, dst_type, support, confidence): type patterns of the steps; of several edges
    of a pair the first type by name counts. Sorted use: by support, then confidence."""
    kind = nodes.groupBy("id").agg(F.min("node_type").alias("node_type"))
    edge = edges.groupBy("src", "dst").agg(F.min("edge_type").alias("edge_type"))
    s = path_steps(paths).join(edge, ["src", "dst"])
    s = s.join(kind.toDF("src", "src_type"), "src").join(kind.toDF("dst", "dst_type"), "dst")
    counted = s.groupBy("src_type", "edge_type", "dst_type").agg(F.count(F.lit(1)).alias("support"))
    return counted.withColumn("confidence", F.col("support") / F.sum("support").over(Window.partitionBy()))


def ranked_patterns(rules: DataFrame, by: str = "support") -> DataFrame:
    """Rules with their place from 1: by (support, confidence), or by their product; ties by pattern.

    There are as many rows as combinations of types, so one task orders them."""
    if by not in ("support", "product"):
        raise ValueError(f"patterns are ranked by support or product, not {by!r}")
    keys = [F.desc("support"), F.desc("confidence")] if by == "support" else [F.desc(F.col("support") * F.col("confidence"))]
    return rules.withColumn("place", F.row_number().over(Window.orderBy(*keys, "src_type", "edge_type", "dst_type")))


def rules_to_bias(rules: DataFrame, cap: float = 1.3) -> DataFrame:
    """(src_type, edge_type, dst_type, bias): 1 + (cap - 1) / 2 * (share of the largest support + confidence), in 0.7 .. cap."""
    share = F.col("support") / F.max("support").over(Window.partitionBy())
    made = 1.0 + (cap - 1.0) * 0.5 * (share + F.col("confidence"))
    return rules.select("src_type", "edge_type", "dst_type", F.least(F.greatest(made, F.lit(0.7)), F.lit(cap)).alias("bias"))


def accumulate_bias(old: DataFrame, new: DataFrame) -> DataFrame:
    """min(1.5, old * (0.7 + 0.3 * new)) where there is a new one; the old starts at 1."""
    keys = ["src_type", "edge_type", "dst_type"]
    both = old.withColumnRenamed("bias", "was").join(new.withColumnRenamed("bias", "now"), keys, "full_outer")
    was = F.coalesce("was", F.lit(1.0))
    return both.select(*keys, F.when(F.col("now").isNull(), was).otherwise(F.least(F.lit(1.5), was * (0.7 + 0.3 * F.col("now")))).alias("bias"))


def score_services(paths: DataFrame, nodes: DataFrame, reference: int | None = None) -> DataFrame:
    """Services on the paths: 0.3 service visits + 0.4 event visits + 0.2 earliness + 0.1 mean abs(zscore).

    Earliness is 1 / (1 + minutes from the earliest time to ``reference``); without a reference it is 0.
    """
    one = nodes.groupBy("id").agg(F.min("node_type").alias("node_type"), F.min("service").alias("service"), F.min(graph.node_time()).alias("at"), F.max(F.abs(graph.node_z())).alias("z"))
    v = paths.select("path_id", F.explode("path").alias("id")).join(one, "id").filter("service is not null")
    s = v.groupBy("service").agg(
        F.count_if(F.col("node_type") == "service").alias("service_count"),
        F.count_if(F.col("node_type") != "service").alias("event_count"),
        F.min("at").alias("min_time"),
        F.avg("z").alias("avg_zscore"),
    )
    early = F.lit(0.0) if reference is None else F.coalesce(1.0 / (1.0 + (F.lit(reference) - F.col("min_time")) / 60.0), F.lit(0.0))
    score = 0.3 * F.col("service_count") + 0.4 * F.col("event_count") + 0.2 * early + 0.1 * F.col("avg_zscore")
    s = s.withColumn("score", score)
    return s.withColumn("count", F.col("service_count") + F.col("event_count")).withColumn("confidence", F.least(F.col("score") / 10, F.lit(1.0)))


def best_root_cause(scored: DataFrame) -> DataFrame:
    """One row: the service of the largest score (ties by name), and why."""
    why = F.when(F.col("avg_zscore") > 2, "metric_anomaly").when(F.col("count") > 5, "service_failure").otherwise("cascade_failure")
    return scored.orderBy(F.desc("score"), "service").limit(1).select("service", why.alias("reason"), F.col("min_time").alias("time"), "confidence")


def start_node(nodes: DataFrame) -> DataFrame:
    """The node with the largest zscore; ties by id."""
    return nodes.filter("zscore is not null").orderBy(F.desc("zscore"), "id").limit(1)


def median_minute(index: DataFrame) -> DataFrame:
    """The minute at place len // 2 of the sorted minutes."""
    place = F.row_number().over(Window.orderBy("minute_ts")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return index.select("minute_ts").distinct().select("minute_ts", place.alias("place"), n.alias("n")).filter("place = floor(n / 2)").select("minute_ts")


def readable(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path_id, steps): each node of a path with its type, service, metric and time, in order."""
    one = nodes.groupBy("id").agg(F.min("node_type").alias("node_type"), F.min("service").alias("service"), F.min("metric").alias("metric"), F.min(graph.node_time()).alias("at"))
    v = paths.select("path_id", F.posexplode("path").alias("step", "id")).join(one, "id", "left")
    return v.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("step", "id", "node_type", "service", "metric", "at"))).alias("steps"))


def with_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends' types and times: of the event, or else of the minute."""
    one = nodes.groupBy("id").agg(F.min("node_type").alias("type"), F.min(graph.node_time()).alias("ts"))
    e = edges.select("src", "dst", "edge_type", "weight")
    return e.join(one.toDF("src", "src_type", "src_ts"), "src").join(one.toDF("dst", "dst_type", "dst_ts"), "dst")


#: How many paths and rules a result carries as evidence.
EVIDENCE_PATHS, EVIDENCE_RULES = 10, 5


def find_root_cause(
    nodes: DataFrame, edges: DataFrame, center: int, start: str, minutes: int = 5, rounds: int = 4, n_walks: int = 200, n_biased: int = 300, seed: int = 12, tolerance: float = 1e-3
) -> DataFrame:
    """(service, reason, time, confidence, evidence_paths, rules_used), one row.

    Walk, learn patterns, bias, walk again, score; the centre moves to the earliest node of all paths;
    ends when there are no paths or the confidence settles. Evidence is the first paths by walk number of
    the last round, and the first patterns by round and rank. A round brings one row of scores, one time
    and whether there are paths to the driver; paths stay tables in the shared folder.
    """
    spark = nodes.sparkSession
    starts = spark.createDataFrame([(start,)], "id string")
    pattern = ["src_type", "edge_type", "dst_type"]
    bias, used, best, paths = None, None, None, None
    for k in range(rounds):
        n, e = graph.window_subgraph(nodes, edges, center, minutes)
        typed = cut(with_types(n, e), "typed")
        paths = _numbered(walks.random_walks(typed, starts, n_walks, seed=seed + k, bias=bias), f"walks{k}")
        if paths.isEmpty():
            break
        learned = cut(pattern_rules(paths, n, e), "patterns")
        new = rules_to_bias(learned)
        bias = cut(accumulate_bias(bias if bias is not None else new.limit(0), new), "bias")
        ranked = ranked_patterns(learned).select(*pattern, F.struct(F.lit(k).alias("round"), "place").alias("at"))
        used = cut((ranked if used is None else used.unionByName(ranked)).groupBy(*pattern).agg(F.min("at").alias("at")), "used")
        if k < rounds - 1:
            biased = _numbered(walks.random_walks(typed, starts, n_biased, seed=seed + 100 + k, bias=bias), f"biased{k}")
            paths = paths if biased.isEmpty() else biased
        found = best_root_cause(score_services(paths, n)).first()
        if found is None or (best is not None and abs(found["confidence"] - best["confidence"]) < tolerance):
            break
        best = found
        on_path = n.join(paths.select(F.explode("path").alias("id")).distinct(), "id", "left_semi")
        earliest = on_path.agg(F.min(graph.node_time()).alias("t")).first()["t"]
        if earliest is None:
            break
        center = int(earliest - earliest % 60)
    shown, rules = [], []
    if paths is not None:
        shown = [r["path"] for r in paths.orderBy("walk", "path_id").limit(EVIDENCE_PATHS).select("path").collect()]
    if used is not None:
        rules = [">".join(r[c] or "" for c in pattern) for r in used.orderBy("at").limit(EVIDENCE_RULES).collect()]
    row = tuple(best) if best else ("unknown", "no_evidence", None, 0.0)
    return spark.createDataFrame([(*row, shown, rules)], f"service string, reason string, time {dict(nodes.dtypes)['event_ts']}, confidence double, evidence_paths array<array<string>>, rules_used array<string>")


def _numbered(paths: DataFrame, name: str) -> DataFrame:
    """Paths under a path_id that is unique over all starts."""
    return cut(paths.select(F.concat_ws("#", "start", F.col("walk").cast("string")).alias("path_id"), "walk", "path"), name)
