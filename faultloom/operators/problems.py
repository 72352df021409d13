"""All problems of a batch at once: where each begins, and the rounds of walks of all unfinished ones together.

What ``rca.find_root_cause`` does for one problem, keyed by problem. A problem's window graph has nodes of its own, named
``problem#id``, so the graphs of all problems are one table of separate parts, and a round takes as many jobs for a
thousand problems as for one. Draws don't depend on the prefix: a problem ends as it would by itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultloom.functions.times import window_in_text
from faultloom.operators import graph, rca, walks
from faultloom.schema import ALLOWED_EDGES
from faultloom.sources.shared import cut, numbered

PATTERN = ("src_type", "edge_type", "dst_type")


def _minute(t: Column) -> Column:
    return (t - F.pmod(t, F.lit(60))).cast("long")


def median_minutes(nodes: DataFrame) -> DataFrame:
    """One row: the minute at place len // 2 of the sorted minutes of a graph."""
    minutes = numbered(nodes.select("minute_ts").distinct(), "minute_ts", "place")
    n = minutes.agg(F.count(F.lit(1)).alias("n"))
    return minutes.filter(F.col("place") == F.floor(n.scalar() / 2)).select("minute_ts")


def chosen(problems: DataFrame, nodes: DataFrame, minutes: int = 5, offset_hours: int = 8) -> DataFrame:
    """(problem, center, start, center_from, start_from) of problems (problem, instruction).

    The centre is the start of the time window in the instruction's text, or else the graph's median minute. The walks start at the metric
    event of the largest abs(zscore) within ``minutes`` of the centre; without one, at the largest of the whole graph;
    without any, at the service of the smallest name. Ties go to the smallest id; a problem without any node has no start.
    """
    text = window_in_text(F.col("instruction"), offset_hours)["start"]
    fallback = median_minutes(nodes)
    asked = problems.select("problem", text.alias("told")).withColumn("median", fallback.scalar())
    asked = asked.select("problem", _minute(F.coalesce("told", "median")).alias("center"), F.when(F.col("told").isNotNull(), "text").otherwise("median").alias("center_from"))
    events = nodes.filter("node_type = 'metric_event' and zscore is not null").select("id", F.abs("zscore").alias("z"), _minute(F.coalesce("event_ts", "minute_ts")).alias("minute"))
    best = lambda: F.min_by("id", F.struct(-F.round("z", 9), F.col("id")))
    near = asked.select("problem", F.explode(F.sequence(F.col("center") - 60 * minutes, F.col("center") + 60 * minutes, F.lit(60).cast("long"))).alias("minute"))
    by_minute = events.groupBy("minute").agg(F.max(F.struct(F.round("z", 9).alias("z"))).alias("top"), best().alias("id"))  # an event a minute is enough
    inside = near.join(by_minute, "minute").groupBy("problem").agg(F.min_by("id", F.struct(-F.col("top.z"), F.col("id"))).alias("inside"))
    of_all = events.groupBy().agg(best().alias("x"))
    of_services = nodes.filter("node_type = 'service'").groupBy().agg(F.min("id").alias("x"))
    joined = asked.join(inside, "problem", "left").withColumn("any", of_all.scalar()).withColumn("service", of_services.scalar())
    source = F.when(F.col("inside").isNotNull(), "window").when(F.col("any").isNotNull(), "graph").when(F.col("service").isNotNull(), "service").otherwise("none")
    return joined.select("problem", "center", F.coalesce("inside", "any", "service").alias("start"), "center_from", source.alias("start_from"))


def _own(problem: Column, name: Column) -> Column:
    return F.concat(problem, F.lit("#"), name)


def windows(nodes: DataFrame, edges: DataFrame, active: DataFrame, minutes: int) -> tuple[DataFrame, DataFrame]:
    """The window graph of each active problem (problem, center), its names its own; joined by the minutes of the windows."""
    wanted = active.select("problem", F.explode(F.sequence(F.col("center") - 60 * minutes, F.col("center") + 60 * minutes, F.lit(60).cast("long"))).alias("minute_ts"))
    own = lambda c: _own(F.col("problem"), F.col(c)).alias(c)
    n = nodes.join(wanted, "minute_ts").select("problem", *[own(c) if c in ("id", "service") else c for c in nodes.columns])
    e = edges.filter(F.col("edge_type").isin(*ALLOWED_EDGES)).join(wanted, "minute_ts").select("problem", *[own(c) if c in ("src", "dst") else c for c in edges.columns])
    return n, e


def _patterns(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, pattern, support, confidence): as ``rca.pattern_rules``, for each problem."""
    kind = nodes.groupBy("id").agg(F.min("node_type").alias("node_type"))
    edge = edges.groupBy("src", "dst").agg(F.min("edge_type").alias("edge_type"), F.min("problem").alias("problem"))
    s = rca.path_steps(paths).join(edge, ["src", "dst"]).join(kind.toDF("src", "src_type"), "src").join(kind.toDF("dst", "dst_type"), "dst")
    counted = s.groupBy("problem", *PATTERN).agg(F.count(F.lit(1)).alias("support"))
    return counted.withColumn("confidence", F.col("support") / F.sum("support").over(Window.partitionBy("problem")))


def _bias(patterns: DataFrame, cap: float = 1.3) -> DataFrame:
    share = F.col("support") / F.max("support").over(Window.partitionBy("problem"))
    made = 1.0 + (cap - 1.0) * 0.5 * (share + F.col("confidence"))
    return patterns.select("problem", *PATTERN, F.least(F.greatest(made, F.lit(0.7)), F.lit(cap)).alias("bias"))


def _accumulated(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.withColumnRenamed("bias", "was").join(new.withColumnRenamed("bias", "now"), ["problem", *PATTERN], "full_outer")
    was = F.coalesce("was", F.lit(1.0))
    return both.select("problem", *PATTERN, F.when(F.col("now").isNull(), was).otherwise(F.least(F.lit(1.5), was * (0.7 + 0.3 * F.col("now")))).alias("bias"))


def _walked(typed: DataFrame, starts: DataFrame, n: int, seed: int, bias: DataFrame | None, name: str) -> DataFrame:
    made = walks.random_walks(typed, starts, n, seed=seed, bias=bias, owned=True)
    problem = F.substring_index("start", "#", 1).alias("problem")
    return cut(made.select(problem, F.concat_ws("#", "start", F.col("walk").cast("string")).alias("path_id"), "walk", "path"), name)


def _scored(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(problem, service, reason, time, confidence): the best service of each problem, as ``rca.best_root_cause``."""
    scored = rca.score_services(paths, nodes).withColumn("problem", F.substring_index("service", "#", 1))
    why = F.when(F.col("avg_zscore") > 2, "metric_anomaly").when(F.col("count") > 5, "service_failure").otherwise("cascade_failure")
    row = F.struct(F.substring_index("service", "#", -1).alias("service"), why.alias("reason"), F.col("min_time").alias("time"), "confidence")
    return scored.groupBy("problem").agg(F.min_by(row, F.struct(-F.col("score"), F.col("service"))).alias("found"))


def find_root_causes(
    nodes: DataFrame, edges: DataFrame, problems: DataFrame, minutes: int = 5, rounds: int = 4, n_walks: int = 200, n_biased: int = 300, seed: int = 12, tolerance: float = 1e-3,
) -> DataFrame:
    """(problem, service, reason, time, confidence, evidence_paths, rules_used), one row for each of problems
    (problem, center, start), as ``rca.find_root_cause`` finds them one by one.

    A problem that needs no further round takes no part in it; the number of jobs is that of the rounds. Problem names hold no "#".
    Problems without a start or without paths are ``unknown``, for ``no_evidence``.
    """
    kind = dict(nodes.dtypes)["event_ts"]
    nothing = F.lit(None).cast(f"struct<service:string,reason:string,time:{kind},confidence:double>")
    state = cut(problems.select(F.col("problem").cast("string").alias("problem"), F.col("center").cast("long").alias("center"), "start", nothing.alias("best"), F.lit(-1).alias("last"), F.col("start").isNull().alias("done")), "problems")
    bias, ranks, shown = None, [], []
    for k in range(rounds):
        active = state.filter("not done")
        n, e = (cut(x, name) for x, name in zip(windows(nodes, edges, active, minutes), ("window-nodes", "window-edges"), strict=True))
        typed = rca.with_types(n, e).withColumn("problem", F.substring_index("src", "#", 1))
        typed = cut(typed, "typed")
        starts = active.select(_own(F.col("problem"), F.col("start")).alias("id"))
        paths = _walked(typed, starts, n_walks, seed + k, bias, f"walks{k}")
        learned = cut(_patterns(paths, n, e), "patterns")
        new = _bias(learned)
        bias = cut(new.withColumn("bias", F.least(F.lit(1.5), 0.7 + 0.3 * F.col("bias"))) if bias is None else _accumulated(bias, new), "bias")
        order = Window.partitionBy("problem").orderBy(F.desc("support"), F.desc("confidence"), *PATTERN)
        ranks.append(learned.select("problem", *PATTERN, F.struct(F.lit(k).alias("round"), F.row_number().over(order).alias("place")).alias("at")))
        had = paths.select("problem").distinct()
        if k < rounds - 1:
            biased = _walked(typed, starts, n_biased, seed + 100 + k, bias, f"biased{k}")
            plain = paths.join(biased.select("problem").distinct(), "problem", "left_anti")
            paths = biased.join(had, "problem", "left_semi").unionByName(plain)
        shown.append(paths.withColumn("round", F.lit(k)))
        one = n.groupBy("id").agg(F.min(graph.node_time()).alias("at"))
        earliest = paths.select("problem", F.explode("path").alias("id")).distinct().join(one, "id").groupBy("problem").agg(F.min("at").alias("earliest"))
        joined = state.join(had.withColumn("walked", F.lit(True)), "problem", "left").join(_scored(paths, n), "problem", "left").join(earliest, "problem", "left")
        settled = F.col("found").isNull() | F.coalesce(F.abs(F.col("found.confidence") - F.col("best.confidence")) < tolerance, F.lit(False))
        ends = F.col("walked").isNull() | settled
        state = cut(
            joined.select(
                "problem", F.when(~F.col("done") & ~ends & F.col("earliest").isNotNull(), _minute(F.col("earliest"))).otherwise(F.col("center")).alias("center"), "start",
                F.when(F.col("done") | ends, F.col("best")).otherwise(F.col("found")).alias("best"),
                F.when(F.col("done"), F.col("last")).otherwise(k).alias("last"), (F.col("done") | ends | F.col("earliest").isNull()).alias("done"),
            ),
            "problems",
        )
        if k < rounds - 1 and state.filter("not done").isEmpty():
            break
    plain = lambda c: F.substring_index(c, "#", -1)
    last = reduce(DataFrame.unionByName, shown).join(state.select("problem", F.col("last").alias("round")), ["problem", "round"])
    place = Window.partitionBy("problem").orderBy("walk", "path_id")
    first = last.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= rca.EVIDENCE_PATHS)
    evidence = first.groupBy("problem").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: F.transform(x["path"], plain)).alias("evidence_paths"))
    used = reduce(DataFrame.unionByName, ranks).groupBy("problem", *PATTERN).agg(F.min("at").alias("at"))
    used = used.withColumn("place", F.row_number().over(Window.partitionBy("problem").orderBy("at"))).filter(F.col("place") <= rca.EVIDENCE_RULES)
    used = used.groupBy("problem").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(">", *[F.coalesce(c, F.lit("")) for c in PATTERN]).alias("rule")))), lambda x: x["rule"]).alias("rules_used"))
    out = state.join(evidence, "problem", "left").join(used, "problem", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return out.select(
        "problem", F.coalesce("best.service", F.lit("unknown")).alias("service"), F.coalesce("best.reason", F.lit("no_evidence")).alias("reason"), F.col("best.time").alias("time"),
        F.coalesce("best.confidence", F.lit(0.0)).alias("confidence"), none("evidence_paths", "array<array<string>>").alias("evidence_paths"), none("rules_used", "array<string>").alias("rules_used"),
    )
