"""Anomalies of metric series against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.functions.attrs import beside

MIN_BASELINE_ROWS = 5


def _finite(df: DataFrame) -> DataFrame:
    return df.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def _spread():
    sd = F.stddev_pop("value")
    return F.when(sd == 0, 1.0).otherwise(sd)


def scored(metrics: DataFrame, base_from: int, start: int, end: int) -> DataFrame:
    """Every finite target row (start <= t <= end) with its zscore over [base_from, start) of its series.

    The baseline is one row a series; series with fewer than MIN_BASELINE_ROWS rows have none.
    """
    finite = _finite(metrics)
    base = finite.filter((F.col("t") >= base_from) & (F.col("t") < start)).groupBy("service", "metric")
    base = base.agg(F.avg("value").alias("mean"), _spread().alias("sd"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_BASELINE_ROWS)
    target = finite.filter(F.col("t").between(start, end))
    return target.join(base.drop("n"), ["service", "metric"]).withColumn("zscore", (F.col("value") - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def baseline_anomalies(metrics: DataFrame, base_from: int, start: int, end: int, threshold: float = 3.0) -> DataFrame:
    return scored(metrics, base_from, start, end).filter(F.abs("zscore") >= threshold)


def series_anomalies(metrics: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Rows far from the mean of their whole series (at least MIN_BASELINE_ROWS finite rows).

    Two passes: series statistics by aggregation, then a join, so that no series sits in one task."""
    finite = _finite(metrics)
    stats = finite.groupBy("service", "metric").agg(F.avg("value").alias("mean"), _spread().alias("sd"), F.count(F.lit(1)).alias("n"))
    joined = finite.join(stats.filter(F.col("n") >= MIN_BASELINE_ROWS).drop("n"), ["service", "metric"])
    return joined.withColumn("zscore", (F.col("value") - F.col("mean")) / F.col("sd")).drop("mean", "sd").filter(F.abs("zscore") >= threshold)


def top_anomaly(scored_rows: DataFrame) -> DataFrame:
    """One row: the largest abs(zscore); on ties the earliest time, then service and metric."""
    rank = F.struct(F.abs("zscore").alias("z"), (-F.col("t")).alias("t"))
    best = scored_rows.groupBy().agg(F.max(rank).alias("best"))
    tied = beside(scored_rows, best).filter((F.abs("zscore") == F.col("best.z")) & (-F.col("t") == F.col("best.t")))
    row = F.min(F.struct("service", "metric", "t", "value", "zscore")).alias("row")
    return tied.groupBy().agg(row).filter("row is not null").select("row.*").withColumn("abs_z", F.abs("zscore"))


def recent(events: DataFrame, reference: int, seconds: int = 300) -> DataFrame:
    """Events at most ``seconds`` before the reference time."""
    return events.filter(F.lit(reference) - F.col("t") <= seconds)


def critical_state(errors, cpu, memory):
    """More than 5 errors, or cpu over 80, or memory over 90; missing values don't count."""
    over = lambda c, limit: F.coalesce(c > limit, F.lit(False))
    return over(errors, 5) | over(cpu, 80) | over(memory, 90)


def service_state(logs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per service: error_count, last_error (message of the latest), last value per metric as a map."""
    errors = logs.filter(F.col("level") == "ERROR").groupBy("service").agg(
        F.count(F.lit(1)).alias("error_count"), F.max_by("message", F.struct("t", "seq")).alias("last_error")
    )
    last = metrics.groupBy("service", "metric").agg(F.max_by("value", F.struct("t", "value")).alias("value"))
    last = last.groupBy("service").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    return errors.join(last, "service", "full_outer").withColumn("error_count", F.coalesce("error_count", F.lit(0)))

