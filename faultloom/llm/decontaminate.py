"""Benchmark decontamination by winnowing [native].

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is one window). Both
sides hash every k-gram (k = ``GRAM``) and keep the smallest hash of each WINDOW - k + 1 neighbouring
k-grams, so every shared span of WINDOW words shares a kept hash. Kept hashes of documents meet those
of items in a join; where they meet, the k-gram is compared word by word and extended to both sides,
and spans of at least WINDOW words are hits. Items shorter than a window have no such guarantee; for
the few lengths that occur, every gram of that length is looked up instead.

Scale: documents move once, and only hashes and matches do so else. The join is on hashes, whose items
side Spark broadcasts only if it finds it small; a passage shared by very many documents is a hot key
of the documents' side alone, which adaptive execution splits. No pairs of documents arise.

Defined results: a null or empty text has no words, hits or items, and the digest of the empty string;
an empty benchmark leaves every document clean; items with equal ids count once; rows with equal ids
are told apart by their text; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultloom.llm._common import ascii_lower, written

WINDOW = 10
GRAM = 5
REACH = WINDOW - GRAM

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _key(id_col: str, text_col: str) -> Column:
    """Tells rows apart; equal rows share results."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def item_words(text: Column) -> Column:
    """Words of lower-cased letters, digits and everything beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), "")


def _grams(w: str, size: int, short: bool) -> Column:
    """Hashes of all grams of ``size`` words, by position; null for texts too short to have a window."""
    mark = F.lit(size if short else 0)
    least = size if short else WINDOW
    return F.when(
        F.size(w) >= least,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(mark, *[F.get(w, i + j) for j in range(size)])
        ),
    )


def _kept(grams: str) -> Column:
    """The smallest hash of every WINDOW - GRAM + 1 neighbouring grams, without repeats."""
    return F.array_distinct(
        F.transform(
            F.sequence(F.lit(0), F.size(grams) - (REACH + 1)),
            lambda i: F.least(*[F.get(grams, i + j) for j in range(REACH + 1)]),
        )
    )


def _context(w: str, i: Column, size: int, reach: int) -> list[Column]:
    """The gram at i, and up to ``reach`` words before (nearest first) and after it."""
    before = F.reverse(F.slice(w, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))))
    return [
        F.slice(w, i + 1, size).alias("gram"),
        before.alias("before"),
        F.slice(w, i + size + 1, reach).alias("after"),
    ]


def _places(w: str, grams: str, wanted: Column, size: int, short: bool) -> Column:
    """Where wanted grams stand: structs of place, hash, gram, before, after."""
    found = F.filter(
        F.transform(grams, lambda h, i: F.struct(i.alias("i"), h.alias("h"))), lambda x: F.array_contains(wanted, x["h"])
    )
    reach = 0 if short else REACH
    return F.coalesce(
        F.transform(
            found,
            lambda x: F.struct(
                x["i"].alias("place"), x["h"].alias("h"), F.lit(0 if short else WINDOW).alias("need"), *_context(w, x["i"], size, reach)
            ),
        ),
        F.array().cast(
            "array<struct<place:int,h:bigint,need:int,gram:array<string>,before:array<string>,after:array<string>>>"
        ),
    )


def _agree(a: str, b: str) -> Column:
    """How many leading words two arrays share."""
    same = F.lit(REACH)
    for k in reversed(range(REACH)):
        same = F.when(F.coalesce(F.get(a, F.lit(k)) == F.get(b, F.lit(k)), F.lit(False)), same).otherwise(F.lit(k))
    return same


def _covered(ranges: Column) -> Column:
    """Number of places in the union of ranges (low, high)."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))
    return F.aggregate(
        F.array_sort(ranges),
        start,
        lambda acc, x: F.struct(
            (acc["total"] + F.greatest(F.lit(0), x["high"] - F.greatest(x["low"], acc["end"]))).alias("total"),
            F.greatest(acc["end"], x["high"]).alias("end"),
        ),
        lambda acc: acc["total"],
    )


def item_fingerprints(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """Kept grams of the items with their contexts, and the lengths of items shorter than a window."""
    w = items.select(F.col(id_col).cast("string").alias("item"), item_words(F.col(text_col)).alias("w"))
    n = F.size("w")
    lengths = sorted(r["n"] for r in w.filter((n > 0) & (n < WINDOW)).select(n.alias("n")).distinct().collect())
    long = w.withColumn("g", _grams("w", GRAM, False))
    long = long.withColumn("kept", F.when(F.col("g").isNotNull(), _kept("g"))).select(
        "item", F.explode(_places("w", "g", F.col("kept"), GRAM, False)).alias("x")
    )
    sides = [long]
    for size in lengths:
        one = w.filter(n == size).withColumn("g", _grams("w", size, True))
        sides.append(one.select("item", F.explode(_places("w", "g", F.col("g"), size, True)).alias("x")))
    found = sides[0]
    for more in sides[1:]:
        found = found.unionByName(more)
    return found.select(
        "item", F.col("x.h").alias("h"), F.col("x.gram").alias("i_gram"), F.col("x.before").alias("i_before"), F.col("x.after").alias("i_after")
    ), lengths


def find(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """key, doc_id, n_words, n_hit, n_items, items (their ids, sorted as strings), contaminated."""
    fingerprints, short = item_fingerprints(items, item_id_col, item_text_col)
    fingerprints = written(fingerprints, "items")
    kinds = [(GRAM, False)] + [(size, True) for size in short]
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = _key("doc_id", "text")

    # Which rows share which kept hashes.
    w = base.select(key.alias("key"), item_words(F.col("text")).alias("w"))
    for k, (size, is_short) in enumerate(kinds):
        w = w.withColumn(f"g{k}", _grams("w", size, is_short))
    hashes = [F.when(F.col("g0").isNotNull(), _kept("g0"))] + [F.array_distinct(f"g{k}") for k in range(1, len(kinds))]
    hashes = F.concat(*[F.coalesce(h, F.array().cast("array<bigint>")) for h in hashes])
    met = w.select("key", F.explode(hashes).alias("h")).join(fingerprints.select("h").distinct(), "h", "left_semi")
    met = written(met.groupBy("key").agg(F.collect_set("h").alias("met")), "met")

    # Where they stand in those rows, compared and extended.
    joined = base.withColumn("key", key).join(met, "key", "left")
    joined = joined.select("doc_id", "key", "met", item_words(F.col("text")).alias("w"))
    joined = joined.select("doc_id", "key", "met", "w", F.size("w").cast("long").alias("n_words"))
    for k, (size, is_short) in enumerate(kinds):
        joined = joined.withColumn(f"g{k}", F.when(F.col("met").isNotNull(), _grams("w", size, is_short)))
    places = F.concat(*[_places("w", f"g{k}", F.col("met"), size, is_short) for k, (size, is_short) in enumerate(kinds)])
    counted = written(joined.select("doc_id", "key", "n_words", F.when(F.col("met").isNotNull(), places).alias("places")), "places")
    at = counted.filter("places is not null").select("key", F.explode("places").alias("x")).select("key", "x.*").distinct()
    pairs = at.join(fingerprints, "h").filter(F.col("gram") == F.col("i_gram"))
    pairs = pairs.withColumn("a", F.when(F.col("need") > 0, _agree("before", "i_before")).otherwise(0))
    pairs = pairs.withColumn("b", F.when(F.col("need") > 0, _agree("after", "i_after")).otherwise(0))
    low, high = F.col("place") - F.col("a"), F.col("place") + F.size("gram") + F.col("b")
    hits = pairs.select("key", "item", low.alias("low"), high.alias("high"), "need").filter(F.col("high") - F.col("low") >= F.col("need"))
    found = hits.groupBy("key").agg(
        F.collect_set(F.struct("low", "high")).alias("ranges"), F.array_sort(F.collect_set("item")).alias("items")
    )
    result = counted.select("doc_id", "key", "n_words").join(found, "key", "left")
    none = F.array().cast("array<string>")
    return result.select(
        "key",
        "doc_id",
        "n_words",
        F.coalesce(_covered(F.col("ranges")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.col("ranges").isNotNull().alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (their ids, sorted as strings), contaminated."""
    return find(docs, items, id_col, text_col, item_id_col, item_text_col).drop("key")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text shares no window with an item."""
    hit = find(docs, items, id_col, text_col).filter("contaminated").select(F.col("key").alias("_key")).distinct()
    return docs.withColumn("_key", _key(id_col, text_col)).join(hit, "_key", "left_anti").drop("_key")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM item_windows
), doc_windows AS (
  SELECT row_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)
), met AS (
  SELECT row_id, p, m.n, item FROM doc_windows m JOIN item_windows t ON m.g = t.g AND m.n = t.n
), hit AS (
  SELECT row_id, count(DISTINCT spot) AS n_hit
  FROM (SELECT row_id, unnest(range(p, p + n)) AS spot FROM (SELECT DISTINCT row_id, p, n FROM met)) GROUP BY row_id
), named AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row_id, item FROM met) GROUP BY row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (row_id) LEFT JOIN named USING (row_id)
"""
