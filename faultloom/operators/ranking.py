"""Service rankings from graphs: component scores, fusion with walk features, re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultloom.functions.attrs import beside

# The weights of the component score and of the fusion.
COMPONENTS = {"self": 0.4, "impact": 0.3, "spread": 0.2, "latency": 0.1}
FUSION = {"twist": 0.6, "reach": 0.2, "density": 0.2, "connections": 0.3}


def component_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per service id: self (events), impact (calls out), spread (services within two calls), latency
    (mean time from its events to what they precede), and their weighted sum."""
    services = nodes.filter("node_type = 'service'").select("id").distinct()
    owned = edges.filter(F.col("edge_type").isin("has_log", "has_metric")).select(F.col("src").alias("id"), F.col("dst").alias("event"))
    own = owned.groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("self"))
    calls = edges.filter("edge_type = 'calls'").select("src", "dst")
    impact = calls.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("impact"))
    once = calls.distinct()
    two = once.join(once.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
    spread = once.union(two).distinct().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("spread"))
    later = edges.filter("edge_type = 'precedes' and dt_seconds is not null").select(F.col("src").alias("event"), "dt_seconds")
    latency = owned.distinct().join(later, "event").groupBy("id").agg(F.avg("dt_seconds").alias("latency"))
    out = services
    for part in (own, impact, spread, latency):
        out = out.join(part, "id", "left")
    out = out.select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in COMPONENTS])
    return out.withColumn("score", sum(F.lit(w) * F.col(c) for c, w in COMPONENTS.items()))


def fuse(scores: DataFrame, features: DataFrame) -> DataFrame:
    """(id, fusion_score): scores moved to 0..1 (0.5 if all are equal) and walk scores over their largest."""
    joined = scores.join(features, "id", "left")
    density = F.col("path_count") / F.greatest(F.lit(1.0), F.col("unique_reach"))
    walk = FUSION["reach"] * F.col("service_reachability") + FUSION["density"] * F.least(density, F.lit(1.0)) + FUSION["connections"] * F.least(F.coalesce("service_connections", F.lit(0.0)) / 5.0, F.lit(1.0))
    joined = joined.withColumn("walk", F.coalesce(walk, F.lit(0.0)))
    ends = joined.groupBy().agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.max("walk").alias("top"))
    j = beside(joined, ends)
    twist = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    part = F.when(F.col("top") > 0, F.col("walk") / F.col("top")).otherwise(F.col("walk"))
    return j.select("id", (FUSION["twist"] * twist + (1 - FUSION["twist"]) * part).alias("fusion_score"))


def ranked(scores: DataFrame, column: str = "score") -> DataFrame:
    """With rank by score; ties by id. Rows are services."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(column), "id")))


def pick_next(ranking: DataFrame, column: str = "score", top: int = 5) -> DataFrame:
    """The one of the top whose score is farthest above the next one's; the first of equal gaps."""
    best = ranking.orderBy(F.desc(column), "id").limit(top)
    w = Window.orderBy(F.desc(column), "id")
    gaps = best.select("id", F.row_number().over(w).alias("place"), (F.col(column) - F.lead(column).over(w)).alias("gap"))
    return gaps.orderBy(F.desc_nulls_last("gap"), "place").limit(1).select("id", "gap")


def rerank(ranking: DataFrame, candidate: str, confidence: float, column: str = "score") -> DataFrame:
    """The candidate's score moves by (confidence - 0.5) / 2."""
    return ranking.withColumn(column, F.when(F.col("id") == candidate, F.col(column) + (confidence - 0.5) * 0.5).otherwise(F.col(column)))


def evidence_confidence(errors, memory):
    """0.5, plus 0.3 for over 10 errors, plus 0.2 for memory over 80."""
    return F.lit(0.5) + F.when(errors > 10, 0.3).otherwise(0.0) + F.when(memory > 80, 0.2).otherwise(0.0)


def total_evidence(sizes):
    """min(sum of the sizes of all evidence lists / 10, 1); sizes is an array."""
    return F.least(F.aggregate(sizes, F.lit(0.0), lambda a, n: a + n) / 10, F.lit(1.0))


def evidence_of(states: DataFrame, services: DataFrame) -> DataFrame:
    """(service, evidence): what is known of each service asked for; an empty list where nothing is."""
    held = states.groupBy("service").agg(F.collect_list("evidence").alias("evidence"))
    empty = F.array().cast(dict(held.dtypes)["evidence"])
    return services.join(held, "service", "left").select("service", F.coalesce("evidence", empty).alias("evidence"))


def sure_service(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: the service of the largest confidence above ``least`` (ties by name); none if there is none."""
    return scored.filter(F.col("confidence") > least).orderBy(F.desc("confidence"), "service").limit(1)


def advice(confidence):
    return F.when(confidence > 0.7, "act").when(confidence > 0.4, "inspect").otherwise("watch")
