"""Attribute and vector functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_attrs(text: Column) -> Column:
    """A JSON object as a map of strings; null, bad or other JSON is an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def merge_attrs(base: Column, over: Column) -> Column:
    """Both maps; on equal keys ``over`` wins."""
    rest = F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k))
    return F.map_concat(rest, over)


def coerce(text: Column) -> Column:
    """A struct (kind, i, f, b, ts, s): the first of null, int, float, bool, timestamp, string that fits."""
    null = text.isNull() | (F.trim(text) == "") | F.lower(text).isin("none", "null", "nan")
    i, f = text.try_cast("bigint"), text.try_cast("double")
    i = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), i)
    b = F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true")
    ts = F.try_to_timestamp(text)
    kind = F.when(null, "null").when(i.isNotNull(), "int").when(f.isNotNull(), "float").when(b.isNotNull(), "bool").when(ts.isNotNull(), "timestamp").otherwise("string")
    only = lambda k, v: F.when(kind == k, v)
    return F.struct(kind.alias("kind"), only("int", i).alias("i"), only("float", f).alias("f"), only("bool", b).alias("b"), only("timestamp", ts).alias("ts"), only("string", text).alias("s"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def repeated_groups(values: Column) -> Column:
    """Groups of the places (from 0) at which an array repeats a value, in order of first place."""
    distinct = F.array_distinct(values)
    places = F.transform(distinct, lambda v: F.filter(F.transform(values, lambda x, i: F.when(x == v, i)), lambda i: i.isNotNull()))
    return F.filter(places, lambda p: F.size(p) > 1)


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a one-row DataFrame in every row, as scalar subqueries (no join)."""
    return df.select("*", *[one.select(c).scalar().alias(c) for c in one.columns])


def _lanes(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows x dimensions, lengths, whether neither the vector nor an entry is null); shorter vectors are padded with zeros."""
    lists = vectors.to_pylist()
    length = np.array([len(v or ()) for v in lists], np.int64)
    whole = np.array([v is not None and None not in v for v in lists], bool)
    out = np.zeros((len(lists), int(length.max(initial=0))))
    for k, v in enumerate(lists):
        if whole[k]:
            out[k, : len(v)] = v
    return out, length, whole


def _norms(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total = total + x[:, k] * x[:, k]
    return np.sqrt(total)


def _best_of_tile(k: int):
    """The ``k`` best rows of each query of a tile by rounded cosine and id; entries are summed up in their order, as ``cosine`` does."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("b")
        (x, x_size, x_whole), (y, y_size, y_whole) = _lanes(queries.column("va")), _lanes(rows.column("vb"))
        x_norm, y_norm = _norms(x), _norms(y)
        a, b = queries.column("a").to_numpy(), rows.column("b").to_numpy()
        shared = min(x.shape[1], y.shape[1])
        found: list[tuple[np.ndarray, ...]] = [(a[:0], b[:0], np.zeros(0), np.zeros(0, bool))]
        for at in range(0, len(a) if len(b) else 0, 64):
            part = slice(at, at + 64)
            total = np.zeros((len(a[part]), len(b)))
            for c in range(shared):
                total += x[part, c, None] * y[None, :, c]
            norm = x_norm[part, None] * y_norm[None]
            use = ~(norm <= 0) & x_whole[part, None] & y_whole[None]
            sim = np.where(use, total / np.where(use, norm, 1.0), 0.0)
            none = use & (x_size[part, None] != y_size[None])
            key = np.where(np.isnan(sim), -np.inf, -np.round(sim, 6))
            key[none] = 2.0
            key[a[part, None] == b[None]] = np.inf
            order = np.argsort(key, axis=1, kind="stable")[:, :k]
            i, j = np.repeat(np.arange(len(order)), order.shape[1]), order.ravel()
            real = key[i, j] < np.inf
            i, j = i[real], j[real]
            found.append((a[part][i], b[j], sim[i, j], none[i, j]))
        ids, others, sims, nulls = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"a": pa.array(ids, queries.schema.field("a").type), "b": pa.array(others, rows.schema.field("b").type), "sim": pa.array(sims, pa.float64(), mask=nulls)})

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int, most: tuple[int, int] = (512, 8192)) -> DataFrame:
    """(a, b, sim, place): for every query (a, va) the ``k`` other rows (b, vb) of the highest cosine, rounded; ties by b.

    All pairs are compared, in tiles of about ``most`` queries and rows; a tile gives its ``k`` best rows a query, so that pairs
    are never rows. The number of pairs is queries times rows by definition.
    """
    kinds = dict(queries.dtypes)["a"], dict(rows.dtypes)["b"]
    queries, rows = queries.filter("a is not null"), rows.filter("b is not null")
    down, across = (max(1, -(-df.count() // n)) for df, n in zip((queries, rows), most, strict=True))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("other", every(across)).withColumn("tile", deal("a", down) * across + F.col("other")).drop("other")
    r = rows.withColumn("other", every(down)).withColumn("tile", F.col("other") * across + deal("b", across)).drop("other")
    best = q.groupBy("tile").cogroup(r.groupBy("tile")).applyInArrow(_best_of_tile(k), f"a {kinds[0]}, b {kinds[1]}, sim double")
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return best.withColumn("sim", F.round("sim", 6)).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
