"""The same logic on streams of events (service, type, severity, ts, value)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from faultloom.sources.shared import shared_folder

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
LATE = "300 seconds"


def source(spark: SparkSession, folder: str, files: str = "*.parquet", per_batch: int = 1) -> DataFrame:
    """Event files of a folder as a stream, a few files a batch; ts is the event time, t its epoch second,
    whatever the session's zone is."""
    raw = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", files).parquet(folder)
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    service = F.concat(F.lit("svc"), (F.col("user_id") % 20).cast("string"))
    named = raw.select("event_id", micros.alias("us"), service.alias("service"), F.col("event_type").alias("type"), "value")
    return named.select("event_id", F.timestamp_micros("us").alias("ts"), F.floor(F.col("us") / 1_000_000).alias("t"), "service", "type", "value")


def sliding_counts(events: DataFrame, size: str = "60 minutes", slide: str = "5 minutes") -> DataFrame:
    """Events and errors a service in sliding windows; later than LATE is dropped, closed windows are evicted."""
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", size, slide).alias("w"), "service")
    counts = w.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "error").alias("errors"))
    return counts.select(F.col("w.start").alias("start"), "service", "n", "errors")


def minute_counts(events: DataFrame) -> DataFrame:
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", "1 minute").alias("w"), "service")
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("minute_ts"), "service", "n")


def _states(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """error_count, last error's time, last value a metric: kept for each service, emitted on each change."""
    errors, last, metrics = state.get if state.exists else (0, None, "")
    values = dict(x.split("=", 1) for x in metrics.split(";") if x)
    for rows in batches:
        rows = rows.sort_values(["t", "event_id"])
        wrong = rows[rows["type"] == "error"]
        errors += len(wrong)
        if len(wrong):
            newest = int(wrong["t"].iloc[-1])
            last = newest if last is None else max(last, newest)
        for kind, value in rows.groupby("type")["value"].last().items():
            values[kind] = repr(float(value))
    state.update((errors, last, ";".join(f"{k}={v}" for k, v in sorted(values.items()))))
    yield pd.DataFrame({"service": [key[0]], "error_count": [errors], "last_error": [last], "anomalous": [errors > 5]})


def service_states(events: DataFrame) -> DataFrame:
    """A row a service and batch: its state after the batch."""
    return events.select("event_id", "t", "service", "type", "value").groupBy("service").applyInPandasWithState(
        _states, "service string, error_count long, last_error long, anomalous boolean", "errors long, last long, metrics string", "update", "NoTimeout"
    )


def upsert_batches(stream: DataFrame, path: str, keys: list[str], name: str, mode: str = "update", checkpoint: str | None = None) -> StreamingQuery:
    """Each batch goes to a folder of its own, so a batch that runs again replaces itself. A stream that is
    started again with its checkpoint goes on where it ended, with its state."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run(stream, write, name, mode, checkpoint)


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], name: str, mode: str = "update", checkpoint: str | None = None) -> StreamingQuery:
    """Without a checkpoint folder the run is one of its own, which no later run continues."""

    spark = stream.sparkSession
    place = checkpoint or f"{shared_folder(spark)}/faultloom-stream-{name}-{uuid.uuid4().hex}"
    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row by batch for each key of what upsert_batches wrote."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("x")).select(*keys, "x.*")


def drain(stream: DataFrame, keys: list[str], name: str, mode: str = "update") -> DataFrame:
    """Runs a stream over all that is there and gives its final rows by key."""
    path = f"{shared_folder(stream.sparkSession)}/faultloom-sink-{name}-{uuid.uuid4().hex}"
    query = upsert_batches(stream, path, keys, name, mode)
    query.awaitTermination()
    return latest(stream.sparkSession, path, keys)
