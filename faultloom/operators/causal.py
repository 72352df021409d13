"""Wide metric frames, gap filling, correlation and the PC algorithm."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultloom.functions.attrs import beside


def column_name(service: Column, metric: Column) -> Column:
    return F.concat_ws("|", service, metric)


def series_means(metrics: DataFrame) -> DataFrame:
    """(t, series, value): mean of each series at each time."""
    return metrics.groupBy("t", column_name(F.col("service"), F.col("metric")).alias("series")).agg(F.avg("value").alias("value"))


def resampled(means: DataFrame, step: int) -> DataFrame:
    """(t, series, value) on a regular grid: the mean of the means in each bucket; empty buckets are null.

    The grid reaches from the first to the last bucket of all series. Its ends are one row; the grid is
    made in the plan.
    """
    bucket = (F.col("t") - F.pmod(F.col("t"), F.lit(step))).alias("t")
    filled = means.groupBy(bucket, "series").agg(F.avg("value").alias("value"))
    ends = filled.groupBy().agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    grid = beside(filled.select("series").distinct(), ends).select("series", F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias("t"))
    return grid.join(filled, ["series", "t"], "left").select("t", "series", "value")


def forward_backward(grid: DataFrame) -> DataFrame:
    """Nulls take the last value before them, else the first after."""
    w = Window.partitionBy("series").orderBy("t")
    last = F.last("value", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("value", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return grid.withColumn("value", F.coalesce(last, first))


def interpolated(grid: DataFrame) -> DataFrame:
    """Nulls lie on the line, by position, between the values around them; at the ends, the nearest value."""
    w = Window.partitionBy("series").orderBy("t")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    g = grid.withColumn("i", F.row_number().over(w))
    at = F.when(F.col("value").isNotNull(), F.col("i"))
    g = g.withColumn("v0", F.last("value", True).over(up)).withColumn("i0", F.last(at, True).over(up))
    g = g.withColumn("v1", F.first("value", True).over(down)).withColumn("i1", F.first(at, True).over(down))
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("i") - F.col("i0")) / (F.col("i1") - F.col("i0"))
    return g.withColumn("value", F.coalesce("value", line, "v0", "v1")).select("t", "series", "value")


def wide(grid: DataFrame, series: list[str]) -> DataFrame:
    return grid.groupBy("t").pivot("series", series).agg(F.first("value"))


def usable_series(grid: DataFrame) -> DataFrame:
    """(series, n, mean, sd) of series that have values and vary."""
    stats = grid.groupBy("series").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return stats.filter("n > 0 and sd <> 0")


def standardized(grid: DataFrame) -> DataFrame:
    """(value - mean) / (sd + 1e-8) for each usable series; nulls become 0."""
    joined = grid.join(usable_series(grid), "series")
    return joined.select("t", "series", F.coalesce((F.col("value") - F.col("mean")) / (F.col("sd") + 1e-8), F.lit(0.0)).alias("value"))


def correlations(grid: DataFrame) -> DataFrame:
    """(a, b, corr) for every two usable series, over the times that both have."""
    z = standardized(grid)
    other = z.select("t", F.col("series").alias("b"), F.col("value").alias("vb"))
    pairs = z.select("t", F.col("series").alias("a"), F.col("value").alias("va")).join(other, "t").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.corr("va", "vb").alias("corr"))


def apart(corr: np.ndarray, n: int, i: int, j: int, given: Sequence[int], alpha: float) -> bool:
    """Whether i and j are independent given others, by Fisher's z of their partial correlation."""
    index = [i, j, *given]
    inv = np.linalg.pinv(corr[np.ix_(index, index)])
    r = -inv[0, 1] / math.sqrt(max(inv[0, 0] * inv[1, 1], 1e-12))
    r = min(max(r, -0.9999999), 0.9999999)
    z = 0.5 * math.log((1 + r) / (1 - r)) * math.sqrt(max(n - len(given) - 3, 1))
    return math.erfc(abs(z) / math.sqrt(2)) > alpha


def parting_set(corr: np.ndarray, n: int, near: np.ndarray, i: int, j: int, size: int, alpha: float) -> tuple[int, ...] | None:
    """The first set of ``size`` neighbours of i, or else of j, given which they are independent; None if there is none."""
    for a, b in ((i, j), (j, i)):
        around = [int(k) for k in np.flatnonzero(near[a]) if k != b]
        for given in itertools.combinations(around, size):
            if apart(corr, n, i, j, given, alpha):
                return given
    return None


def oriented(near: np.ndarray, parted: dict[tuple[int, int], tuple[int, ...]]) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
    """(directed, undirected) edges of a skeleton: colliders first, then what they force."""
    k = len(near)
    arrow = np.zeros((k, k), bool)
    for m in range(k):
        around = np.flatnonzero(near[m])
        for i, j in itertools.combinations(around.tolist(), 2):
            if not near[i, j] and m not in parted.get((i, j), ()):
                arrow[i, m] = arrow[j, m] = True
    open_ = near & ~arrow & ~arrow.T
    moved = True
    while moved:
        moved = False
        for i, j in np.argwhere(open_).tolist():
            if not open_[i, j]:
                continue
            comes = arrow[:, i] & ~near[:, j]
            comes[j] = False
            if comes.any() or (arrow[i] & arrow[:, j]).any():  # away from a collider, around no circle
                arrow[i, j] = moved = True
                open_[i, j] = open_[j, i] = False
    both = (arrow & arrow.T) | open_
    return {(i, j) for i, j in np.argwhere(arrow & ~arrow.T).tolist()}, {(i, j) for i, j in np.argwhere(both).tolist() if i < j}


def _named(names: list[str], edges: tuple[set[tuple[int, int]], set[tuple[int, int]]]) -> list[tuple[str, str, str]]:
    return [(names[i], names[j], kind) for kind, found in zip(("directed", "undirected"), edges, strict=True) for i, j in sorted(found)]


def pc(names: list[str], corr: np.ndarray, n: int, alpha: float = 0.05) -> list[tuple[str, str, str]]:
    """(a, b, kind) edges of the stable PC algorithm by Fisher's z: ``directed`` a -> b, or ``undirected``.

    The plain search, for a few series; ``causal_edges`` deals the tests of each level to tasks.
    """
    near = ~np.eye(len(names), dtype=bool)
    parted: dict[tuple[int, int], tuple[int, ...]] = {}
    for size in itertools.count():
        if near.sum(axis=1).max(initial=0) <= size:
            break
        held = near.copy()
        for i, j in np.argwhere(np.triu(held)).tolist():
            given = parting_set(corr, n, held, i, j, size, alpha)
            if given is not None:
                near[i, j] = near[j, i] = False
                parted[i, j] = given
    return _named(names, oriented(near, parted))


def _level(spark: SparkSession, corr: np.ndarray, n: int, near: np.ndarray, size: int, alpha: float) -> dict[tuple[int, int], tuple[int, ...]]:
    """The edges that a level removes, with their parting sets. Edges are dealt to tasks; each task has the matrix and
    the neighbours as they are at the level's begin, which is what makes the search stable, so the order is free."""
    shared = spark.sparkContext.broadcast((corr, near))
    edges = np.argwhere(np.triu(near))
    table = pa.table({"i": edges[:, 0].astype(np.int32), "j": edges[:, 1].astype(np.int32)})

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, around = shared.value
        for batch in batches:
            out = []
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                given = parting_set(matrix, n, around, i, j, size, alpha)
                if given is not None:
                    out.append((i, j, list(given)))
            i, j, given = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(given, pa.list_(pa.int32()))], ["i", "j", "given"])

    parts = min(len(edges), max(spark.sparkContext.defaultParallelism, len(edges) // EDGES_A_TASK))
    found = spark.createDataFrame(table).repartition(parts, "i", "j").mapInArrow(tested, "i int, j int, given array<int>").toArrow()
    shared.destroy()
    return {(i, j): tuple(given) for i, j, given in zip(*(c.to_pylist() for c in found.columns), strict=True)}


#: Edges whose tests are one task's work, beyond as many tasks as the session runs at once.
EDGES_A_TASK = 500


def causal_edges(grid: DataFrame, alpha: float = 0.05, max_series: int = 2000) -> DataFrame:
    """(a, b, kind): PC over all usable series, level by level on the executors.

    More than ``max_series`` are an error: the matrix of their number squared, at most 32 MB, goes to every task; split
    such grids into parts that can be causes of each other. What comes back of a level are its removed edges, which
    are fewer than the pairs of series. The first level, independence without conditions, is decided from the matrix.
    """
    spark = grid.sparkSession
    names = sorted(r["series"] for r in usable_series(grid).select("series").limit(max_series + 1).collect())
    if len(names) > max_series:
        raise ValueError(f"more than {max_series} usable series")
    made = correlations(grid).toArrow()
    place = {s: k for k, s in enumerate(names)}
    corr = np.eye(len(names))
    a, b = (np.array([place[x] for x in made.column(c).to_pylist()], np.int64) for c in ("a", "b"))
    corr[a, b] = corr[b, a] = np.nan_to_num(made.column("corr").fill_null(0.0).to_numpy())
    n = grid.select("t").distinct().count()
    near = ~np.eye(len(names), dtype=bool)
    parted: dict[tuple[int, int], tuple[int, ...]] = {}
    for size in itertools.count():
        if near.sum(axis=1).max(initial=0) <= size:
            break
        if size:
            gone = _level(spark, corr, n, near, size, alpha)
        else:
            gone = {(i, j): () for i, j in np.argwhere(np.triu(near & unlinked(corr, n, alpha))).tolist()}
        for i, j in gone:
            near[i, j] = near[j, i] = False
        parted |= gone
    return spark.createDataFrame(_named(names, oriented(near, parted)), "a string, b string, kind string")


def unlinked(corr: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Which pairs are independent without conditions, as ``apart`` says of each: one look at the whole matrix."""
    r = np.clip(corr, -0.9999999, 0.9999999)
    z = np.abs(0.5 * np.log((1 + r) / (1 - r)) * math.sqrt(max(n - 3, 1)))
    near = np.abs(z - _quantile(alpha)) < 1e-6
    out = z < _quantile(alpha)
    for i, j in np.argwhere(near & ~np.eye(len(corr), dtype=bool)).tolist():  # so close that the last digits decide
        out[i, j] = apart(corr, n, i, j, (), alpha)
    return out


def _quantile(alpha: float) -> float:
    """The z beyond which a share alpha of a standard normal lies on both sides: by halving."""
    low, high = 0.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erfc(middle / math.sqrt(2)) > alpha else (low, middle)
    return low
