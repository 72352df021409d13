"""Tables between rounds of iterative operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a local session may have neither; then it is a folder of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = of_context.get() if of_context.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "faultloom-shared")
    return found


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/faultloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Spark drops the shuffle files of finished jobs once the driver has collected what named them."""
    spark._jvm.System.gc()


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """The rows with their place from 0 in the order of a column: ranges are numbered apart and offset by the
    sizes of those before, so no task holds all rows; only the sizes, a row a range, meet in one."""
    ranges = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranges.join(sizes.select("_part", before.alias("_before")), "_part").withColumn(name, (place + F.col("_before")).cast("long")).drop("_part", "_before")
