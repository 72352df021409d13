"""Ranks and metrics of candidate scores (query_id, cand, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filter_known(cands: DataFrame, queries: DataFrame, facts: DataFrame) -> DataFrame:
    """Without candidates that answer the same (s, r, t) truly, but the query's own answer o."""
    truth = queries.select("query_id", "s", "r", "t", F.col("o").alias("answer")).join(facts.select("s", "r", "t", F.col("o").alias("cand")), ["s", "r", "t"])
    # A list a query, so that candidates which are dealt by query stay where they are.
    others = truth.filter("cand <> answer").groupBy("query_id").agg(F.collect_set("cand").alias("_known"))
    met = cands.join(others, "query_id", "left")
    return met.filter(~F.coalesce(F.array_contains("_known", F.col("cand")), F.lit(False))).select(*cands.columns)


def _with_answers(cands: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates of the queries beside their answers; those dealt by query don't move."""
    return cands.join(queries.groupBy("query_id").agg(F.collect_set("o").alias("_answers")), "query_id")


def tied_ranks(cands: DataFrame, queries: DataFrame, num_entities: int) -> DataFrame:
    """(query_id, best, average, worst): rank of the answer o among the candidates; num_entities if absent."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    r = _with_answers(cands, queries).withColumn("best", F.rank().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id", "score")))
    r = r.filter(F.array_contains("_answers", F.col("cand"))).select("query_id", F.col("cand").alias("o"), "best", (F.col("best") + F.col("n") - 1).alias("worst"))
    r = queries.select("query_id", "o").join(r, ["query_id", "o"], "left")
    average = F.floor((F.col("best") - 1 + F.col("worst") - 1) / 2) + 1
    return r.select("query_id", *[F.coalesce(c, F.lit(num_entities)).cast("long").alias(n) for c, n in ((F.col("best"), "best"), (average, "average"), (F.col("worst"), "worst"))])


def filtered_ranks(cands: DataFrame, queries: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, ill, harsh, balance): 1 + others with a greater score; with a score at least as great;
    place among others in descending order (ties: larger candidate first), or after all with a score
    when the answer has none. Other true answers are left out."""
    met = filter_known(cands, queries, facts).join(queries.select("query_id", F.col("o").alias("answer")), "query_id", "right")
    # The answer itself is among what is left, so its score needs no second look at the candidates.
    own = F.max(F.when(F.col("cand") == F.col("answer"), F.col("score"))).over(Window.partitionBy("query_id", "answer"))
    others = met.withColumn("own", own).filter("cand is null or cand <> answer")
    mine = F.coalesce("own", F.lit(0.0))
    counted = others.groupBy("query_id").agg(
        (F.count_if(F.col("score") > mine) + 1).alias("ill"),
        (F.count_if(F.col("score") >= mine) + 1).alias("harsh"),
        (F.count_if(F.when(mine != 0, (F.col("score") > mine) | ((F.col("score") == mine) & (F.col("cand") > F.col("answer")))).otherwise(F.col("score") != 0)) + 1).alias("balance"),
    )
    # Queries without other candidates have lost their row in the filter: they rank first.
    full = queries.select("query_id").join(counted, "query_id", "left")
    return full.select("query_id", *[F.coalesce(c, F.lit(1)).alias(c) for c in ("ill", "harsh", "balance")])


def hits_and_mrr(ranks: DataFrame, column: str = "best") -> DataFrame:
    r = F.col(column)
    hit = lambda k: F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"hits{k}")
    return ranks.agg(hit(1), hit(3), hit(10), F.avg(1 / r).alias("mrr"), F.count(F.lit(1)).alias("n"))


def blended(both: DataFrame, weight: float = 0.5) -> DataFrame:
    """weight * a + (1 - weight) * b of (query_id, cand, a, b); a side that lacks a candidate counts 0."""
    mixed = F.lit(weight) * F.coalesce("a", F.lit(0.0)) + F.lit(1 - weight) * F.coalesce("b", F.lit(0.0))
    return both.select("query_id", "cand", mixed.alias("score"))


def blend(cands: DataFrame, scores: DataFrame, weight: float = 0.5) -> DataFrame:
    """weight * rule score + (1 - weight) * model score; a side that lacks a candidate counts 0."""
    rule, model = cands.withColumnRenamed("score", "a"), scores.withColumnRenamed("score", "b")
    return blended(rule.join(model, ["query_id", "cand"], "full_outer"), weight)


def interval_distance(queries: DataFrame, valid_last: int) -> DataFrame:
    return queries.select("t").distinct().withColumn("distance", F.col("t") - valid_last)
