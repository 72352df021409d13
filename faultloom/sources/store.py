"""A graph store partitioned by minute, with a manifest of its minutes.

``nodes`` and ``edges`` are Parquet folders with a folder for each minute; the manifest says of each minute how many rows
it has and carries a digest of them. A merge compares digests and rewrites only the minutes that differ. The
manifest is written after the data, as rows of a batch of its own; a merge that breaks off before that is made
again by the next one. Stores have one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom import schema
from faultloom.sources.readers import exists
from faultloom.sources.shared import cut

MANIFEST = "minute_ts bigint, nodes_count bigint, edges_count bigint, digest string, batch bigint"


def digests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(minute_ts, nodes_count, edges_count, digest) of a graph: two sums over hashes of each minute's rows, whatever their order."""
    rows = [df.select("minute_ts", F.lit(k).alias("k"), F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)], F.lit(k)).alias("h")) for k, df in enumerate((nodes, edges))]
    of_kind = lambda k: F.count_if(F.col("k") == k)
    sums = F.concat_ws("-", F.sum(F.col("h").cast("decimal(38,0)")).cast("string"), F.bit_xor("h").cast("string"))
    return rows[0].union(rows[1]).groupBy("minute_ts").agg(of_kind(0).alias("nodes_count"), of_kind(1).alias("edges_count"), sums.alias("digest"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(minute_ts, nodes_count, edges_count, digest, batch) of each minute of a store; empty where there is none. Minutes without rows are gone."""
    if not exists(spark, f"{folder}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    rest = ["nodes_count", "edges_count", "digest", "batch"]
    newest = rows.groupBy("minute_ts").agg(F.max_by(F.struct(*rest), F.col("batch")).alias("x")).select("minute_ts", "x.*")
    return newest.filter("nodes_count > 0 or edges_count > 0")


def changed(spark: SparkSession, folder: str, nodes: DataFrame, edges: DataFrame, whole: bool = False) -> DataFrame:
    """The minutes, as in the manifest, in which a graph differs from what a store has of them; with ``whole``, also those
    that only the store has, with no rows."""
    both = digests(nodes, edges).join(manifest(spark, folder).select("minute_ts", F.col("digest").alias("was")), "minute_ts", "full_outer")
    differs = F.coalesce(F.col("digest") != F.col("was"), F.lit(True)) & (F.lit(whole) | F.col("digest").isNotNull())
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return both.filter(differs).select("minute_ts", zero("nodes_count"), zero("edges_count"), "digest")


def merge(nodes: DataFrame, edges: DataFrame, folder: str, whole: bool = False) -> DataFrame:
    """Brings a store up to date with a graph's minutes and gives the manifest rows of those that it rewrote.

    With ``whole`` the graph is all there is: minutes that it lacks go. A store that is up to date isn't written to.
    """
    spark = nodes.sparkSession
    news = cut(changed(spark, folder, nodes, edges, whole), "minutes")
    batch = (manifest(spark, folder).agg(F.max("batch").alias("b")).first()["b"] or 0) + 1
    out = news.select("minute_ts", "nodes_count", "edges_count", "digest", F.lit(batch).cast("long").alias("batch"))
    if news.isEmpty():
        return out
    for name, rows, count in (("nodes", nodes, "nodes_count"), ("edges", edges, "edges_count")):
        some = news.filter(F.col(count) > 0).select("minute_ts")
        # Rows of a minute are dealt by minute, so a minute is a file or, where it is large, a few.
        part = rows.join(some, "minute_ts", "left_semi").hint("rebalance", "minute_ts")
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("minute_ts").parquet(f"{folder}/{name}")
        for r in news.filter(F.col(count) == 0).select("minute_ts").toLocalIterator():  # folders that hold nothing any more
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/minute_ts={r['minute_ts']}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    out.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return out


def window(spark: SparkSession, folder: str, center: int, minutes: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the minutes center -/+ minutes: only their folders are read."""
    inside = F.col("minute_ts").between(center - 60 * minutes, center + 60 * minutes)
    nodes, edges = (spark.read.schema(kind).parquet(f"{folder}/{name}").filter(inside) for name, kind in (("nodes", schema.NODES), ("edges", schema.EDGES)))
    return nodes, edges.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
