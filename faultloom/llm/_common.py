"""Helpers shared by the training-data operators: words, shared tables, table access."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the corpus operators: a run of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may name none; then it is a folder of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = context_dir.get() if context_dir.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "faultloom-shared")
    return found


_made = threading.local()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: computed once, its lineage cut,
    readable by every executor, so that a lost executor costs no more than the running tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/faultloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.faultloom_path = path
    if getattr(_made, "tracking", False):
        _made.paths.append(path)
    return made


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    _remove(spark, [t.faultloom_path for t in tables])


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written within are of one stage: they go when this thread's next stage begins or ``end_stages``
    is called, by when the stage's rows must be written. Tables written elsewhere stay."""
    end_stages(spark)
    _made.tracking = True
    try:
        yield
    finally:
        _made.tracking = False


def end_stages(spark: SparkSession) -> None:
    """Removes the tables of this thread's last stage."""
    _remove(spark, getattr(_made, "paths", []))
    _made.paths = []


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _made.paths = [p for p in getattr(_made, "paths", []) if p not in paths]
    # Spark drops the shuffle files of finished jobs once the driver has collected what named them.
    spark._jvm.System.gc()


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """The rows with their place from 0 in an order, as a table: ranges of the order are numbered apart and
    offset by the sizes of those before, so no task holds all rows."""
    ranges = written(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    placed = ranges.join(sizes.select("_part", before.alias("_before")), "_part")
    return placed.withColumn(name, (place + F.col("_before")).cast("long")).drop("_part", "_before")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(text, UPPER, LOWER)
