"""Token counting and packing of prompts around a pluggable counter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultloom.sources.shared import cut

# Token limits of models.
LIMITS = {
    "gpt-4": 8192, "gpt-4-0613": 8192, "gpt-3.5-turbo-16k": 16384, "gpt-3.5-turbo-16k-0613": 16384, "gpt-3.5-turbo-0125": 16384,
    "gpt-3.5-turbo": 4096, "gpt-3.5-turbo-0613": 4096, "text-davinci-003": 4096, "text-davinci-002": 4096, "gpt-4o-mini": 128000,
}


def word_counter(texts: pd.Series) -> pd.Series:
    return texts.fillna("").str.split().str.len()


def counts(text: Column, counter: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """Tokens of a text by a counter; words, counted by Spark itself, without one."""
    if counter is None:
        return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield counter(b).astype("int64")

    return F.pandas_udf(run, "long")(text)


def limit_for(model: str) -> int:
    """Tokens that a model takes; an error for a model without a known limit."""
    if model not in LIMITS:
        raise ValueError(f"no token limit is known for {model!r}")
    return LIMITS[model]


def packed(rows: DataFrame, limit: int, counter: Callable[[pd.Series], pd.Series] = word_counter) -> DataFrame:
    """(key, pack, text): texts of a key (key, seq, text) put together in order while they fit the limit;
    a text beyond the limit stands alone. Sequential within a key, which is one prompt's material."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        sizes, packs, room = counter(part["text"]).tolist(), [], 0
        for text, n in zip(part["text"], sizes, strict=True):
            if packs and n <= room:
                packs[-1].append(text)
                room -= n
            else:
                packs.append([text])
                room = limit - n
        return pd.DataFrame({"key": part["key"].iloc[0], "pack": range(len(packs)), "text": ["\n".join(p) for p in packs]})

    return rows.groupBy("key").applyInPandas(run, "key string, pack long, text string")


def packs(rows: DataFrame, limit: int, counter: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """(key, pack, seq, text): rows (key, seq, text) dealt to packs of at most ``limit`` tokens, a longer text alone, in the
    order of seq.

    By prefix sums: the tokens of a key, laid end to end, are cut at the multiples of the limit; the texts between two
    cuts are a pack, a text across a cut is one by itself. Sums run over ranges of (key, seq) apart and over
    the ranges' totals, so no task holds a key.
    """
    sized = rows.select("key", "seq", "text", counts(F.col("text"), counter).alias("n"))
    ranged = cut(sized.repartitionByRange("key", "seq", "text").withColumn("_part", F.spark_partition_id()), "packs")
    totals = ranged.groupBy("key", "_part").agg(F.sum("n").alias("all"))
    until = lambda keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("key", "_part", F.coalesce(F.sum("all").over(until(["key"], ["_part"])), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(until(["key", "_part"], ["seq", "text"])), F.lit(0))
    placed = ranged.withColumn("inside", inside).join(before, ["key", "_part"]).withColumn("a", F.col("before") + F.col("inside"))
    first, last = F.floor(F.col("a") / limit), F.floor((F.col("a") + F.greatest("n", F.lit(1)) - 1) / limit)
    return placed.select("key", (2 * first + (first != last).cast("long")).alias("pack"), "seq", "text")


def trimmed(rows: DataFrame, limit: int, counter: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """The first texts of each key, by seq, whose counts together stay within the limit."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("n", counts(F.col("text"), counter)).withColumn("upto", F.sum("n").over(w)).filter(F.col("upto") <= limit).drop("n", "upto")
