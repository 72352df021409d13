"""Mixing sources to target weights [native]: Pareto order sampling.

A source's target is its share, by weight, of all words, at most ``max_repeats`` times its own size.
Every document of a source with target ratio r = target / source size is taken floor(r) times for
certain. The words that are left are filled with one more copy of some documents, in unequal
probability: a document's inclusion probability p goes with the weight 2 ** c of its size class
c = floor(log4(size)), so about with the root of its size, such that the words expected are the words
left. Classes whose p would reach 1 get that copy for certain. The rest are taken in Pareto order: by
ascending q = (u / (1 - u)) / (p / (1 - p)), u being the document's random number. The sample's size
is fixed in words: documents are taken while they fit, and the one that crosses the target is taken if
that comes nearer to it.

u is made of an md5 digest of seed, document id and text, so reruns, retried tasks and other engines agree.

Scale: only (id, source, size, digest of the text) move. The running sum in Pareto order is taken in two
levels: sums of ``BUCKETS`` slices of the order for each source, then within one slice. A slice is cut on
the share of the source that is expected up to q, sum over classes of n * u(q, p) / sum of n, so slices
are of equal size whatever the probabilities are, and no task holds a source, however hot it is.
Sources, of which there may be many, are numbered in ranges and capped by rounds of one-row sums.

Defined results: a null or empty text has size 0 and is taken 0 times (0 words); a null source is a
source of its own, last in order; rows equal in id, source and text are separate documents that share
their random number, of which any may be the one taken more often; equal ids with different texts have
numbers of their own; an empty table gives an empty result. ``take`` keeps every other column; an input
column ``copies`` is replaced, and internal names start with ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultloom.llm._common import numbered, words, written

BUCKETS = 4096
HEX_DIGITS = 13  # 52 bits: exact in a double
MAX_ROUNDS = 100


def random_number(key: Column, seed: str) -> Column:
    """A number in (0, 1) fixed by key and seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**HEX_DIGITS))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """(source, source_size) -> with target: weights by code-point order of the source, nulls last.

    The share that a capped source cannot take goes to the others by weight until none is above its cap:
    rounds in each of which the sources over their share are capped and the sums of the others are taken.
    """
    exact = "decimal(38,0)"
    s = numbered(sources, F.col("source").asc_nulls_last(), "place")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    s = written(s.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_repeats).alias("cap")), "sources")
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    over = F.lit(False)
    for _ in range(MAX_ROUNDS):
        capped = s.withColumn("over", over).agg(
            F.coalesce(F.sum(F.when(F.col("over"), F.col("cap"))), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(~F.col("over"), F.col("weight"))), F.lit(0)).alias("weight"),
            F.count_if("over").alias("n"),
        ).first()
        free, w_free = total - capped["words"], capped["weight"]
        now = over | (F.col("cap").cast(exact) * F.lit(w_free).cast(exact) <= F.col("weight").cast(exact) * F.lit(free).cast(exact))
        if not w_free or s.filter(now).count() == capped["n"]:
            break
        over = now
    else:
        raise RuntimeError(f"targets did not settle in {MAX_ROUNDS} rounds")
    share = (F.col("weight") * F.lit(free).cast("long")).cast("double") / F.lit(float(w_free or 1))
    return s.select("source", "source_size", F.when(over, F.col("cap").cast("double")).otherwise(share).alias("target"))


def size_class(size: Column) -> Column:
    """floor(log4(size)) of a positive size, by its bits."""
    return F.floor((F.length(F.conv(size, 10, 2)) - 1) / 2).cast("int")


def class_odds(strata: DataFrame) -> DataFrame:
    """(source, class, n, words, rest) -> with sure (one more copy for certain), left (words that sampling
    has to fill) and p; rows are classes, at most 32 a source.

    Of the largest weights, classes are sure as long as weight * words left >= weighted words left.
    """
    down = Window.partitionBy("source").orderBy(F.desc("class"))
    before, after = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    own = Window.partitionBy("source")
    s = strata.withColumn("weight", F.pow(F.lit(2.0), F.col("class")).cast("long"))
    s = s.withColumn("weighted", F.col("weight") * F.col("words"))
    s = s.withColumn("open", F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0)).cast("double"))
    s = s.withColumn("sure", (F.col("open") > 0) & (F.col("weight").cast("double") * F.col("open") >= F.sum("weighted").over(after).cast("double")))
    s = s.withColumn("left", F.col("rest") - F.sum(F.when(F.col("sure"), F.col("words")).otherwise(0)).over(own).cast("double"))
    w_left = F.sum(F.when(F.col("sure"), 0).otherwise(F.col("weighted"))).over(own).cast("double")
    p = F.when(F.col("sure") | (F.col("left") <= 0), 0.0).otherwise(F.col("weight").cast("double") * F.col("left") / w_left)
    return s.withColumn("p", p)


def _expected(q: Column, classes: Column) -> Column:
    """The share of a source's sampled documents expected to have at most q: classes is an array of (n, odds)."""
    part = lambda c: c["n"] * (q * c["odds"]) / (1 + q * c["odds"])
    total = F.aggregate(classes, F.lit(0.0), lambda a, c: a + c["n"])
    return F.aggregate(classes, F.lit(0.0), lambda a, c: a + part(c)) / total


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """Per document: doc_id, source, row (md5 of the text), size, source_size, target, p, copies, taken (words taken, repeats counted)."""
    return _mixed(docs, id_col, text_col, source_col, weights, max_repeats, seed).drop("slice")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], max_repeats: int, seed: str) -> DataFrame:
    text = F.col(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.size(words(text)).cast("long").alias("size"),
        F.md5(F.coalesce(text, F.lit(""))).alias("row"),
    )
    sized = written(sized.withColumn("class", F.when(F.col("size") > 0, size_class(F.col("size")))), "mix")
    strata = written(sized.groupBy("source", "class").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("size").alias("words")), "strata")
    targets = source_targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeats)
    size = F.col("source_size")
    certain = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    targets = targets.withColumn("certain", certain).withColumn("rest", F.col("target") - (F.col("certain") * size).cast("double"))

    same_source = F.col("source").eqNullSafe(F.col("of_source"))
    named = targets.withColumnRenamed("source", "of_source")
    classes = strata.filter("class is not null").join(named.select("of_source", "rest"), same_source).drop("of_source")
    classes = written(class_odds(classes), "classes")
    odds = F.struct("n", (F.col("p") / (1 - F.col("p"))).alias("odds"))
    sampled = classes.filter("p > 0").groupBy("source").agg(F.array_sort(F.collect_list(odds)).alias("sampled"))
    table = classes.select("source", "class", "sure", "left", "p").join(named, same_source).drop("of_source")
    table = table.join(sampled.withColumnRenamed("source", "of_source"), same_source, "left").drop("of_source", "rest")
    empty = named.select(F.col("of_source").alias("source"), F.lit(None).cast("int").alias("class"), F.lit(False).alias("sure"), F.lit(0.0).alias("left"), F.lit(0.0).alias("p"), "source_size", "target", "certain")
    table = table.unionByName(empty, allowMissingColumns=True).withColumnRenamed("source", "of_source").withColumnRenamed("class", "of_class")

    d = sized.join(table, same_source & F.col("class").eqNullSafe(F.col("of_class")), "left").drop("of_source", "of_class", "class")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "row")
    d = d.withColumn("u", random_number(key, seed))
    d = d.withColumn("q", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
    at = F.coalesce(_expected(F.col("q"), F.col("sampled")), F.col("u"))
    d = d.withColumn("slice", F.least(F.floor(at * BUCKETS), F.lit(BUCKETS - 1)).cast("int")).drop("sampled")
    # Documents that aren't sampled don't count in the order; they are in slices of their own.
    d = d.withColumn("slice", F.when(F.col("q").isNull(), -1 - F.col("slice")).otherwise(F.col("slice")))
    d = d.withColumn("weighs", F.when(F.col("q").isNull(), 0).otherwise(F.col("size")))

    slices = d.groupBy("source", "slice").agg(F.sum("weighs").alias("in_slice"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        F.col("source").alias("s_source"),
        F.col("slice").alias("s_slice"),
        F.coalesce(F.sum("in_slice").over(upto), F.lit(0)).alias("before_slice"),
    )
    d = d.join(slices, F.col("source").eqNullSafe(F.col("s_source")) & F.col("slice").eqNullSafe(F.col("s_slice")), "left")
    within = Window.partitionBy("source", "slice").orderBy("q", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("upto", F.col("before_slice") + F.sum("weighs").over(within))
    fits = F.col("upto") - F.col("size") / 2 <= F.col("left")
    begins = (F.col("upto") - F.col("size")).cast("double") < F.col("left")
    more = F.when(F.col("sure") | (F.col("q").isNotNull() & begins & fits), 1).otherwise(0)
    d = d.withColumn("copies", F.when(F.col("size") > 0, F.col("certain") + more).otherwise(0).cast("long"))
    return d.select("doc_id", "source", "row", "size", "source_size", "target", "p", "copies", (F.col("copies") * F.col("size")).alias("taken"), "slice")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix with copies, how often each is taken; rows that aren't taken go.

    Rows that are equal in id, source and text get the copies of their group: the same number each, or,
    in the one group of a source that its target cuts, one more for as many of them as the mix took more
    often. Only that group's rows are numbered.
    """
    docs = docs.drop("copies")
    seat = lambda i, source, row: F.sha2(F.to_json(F.struct(i.cast("string").alias("i"), source.alias("s"), row.alias("r")), {"ignoreNullFields": "false"}), 256)
    mixed = mix(docs, id_col, text_col, source_col, **options)
    mixed = mixed.groupBy(seat(F.col("doc_id"), F.col("source"), F.col("row")).alias("_mix_seat")).agg(
        F.min("copies").alias("_mix_least"), F.max("copies").alias("_mix_most"), F.count_if(F.col("copies") > F.lit(0)).alias("_mix_n"), F.sum("copies").alias("_mix_sum"), F.count(F.lit(1)).alias("_mix_rows")
    ).filter("_mix_most > 0")
    mixed = written(mixed, "taken")
    seated = docs.withColumn("_mix_seat", seat(F.col(id_col), F.col(source_col), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    even = mixed.filter("_mix_least = _mix_most").select("_mix_seat", F.col("_mix_most").alias("copies"))
    found = seated.join(even, "_mix_seat").drop("_mix_seat")
    cut = mixed.filter("_mix_least < _mix_most").select("_mix_seat", "_mix_least", (F.col("_mix_sum") - F.col("_mix_least") * F.col("_mix_rows")).alias("_mix_more"))
    if cut.isEmpty():
        return found
    place = F.row_number().over(Window.partitionBy("_mix_seat").orderBy("_mix_seat"))
    uneven = seated.join(cut, "_mix_seat").withColumn("_mix_place", place)
    copies = (F.col("_mix_least") + (F.col("_mix_place") <= F.col("_mix_more")).cast("long")).alias("copies")
    return found.unionByName(uneven.select(*docs.columns, copies).filter("copies > 0"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS row, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         3 * source_size AS cap, sum(source_size) OVER () AS total
  FROM sources
), levels AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM weighted
), decided AS (
  SELECT *, cap * w_left <= weight * (total - c_before) AS capped FROM levels
), targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) AS DOUBLE)
                   / CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target
  FROM decided
), ratios AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS certain FROM targets
), parts AS (
  SELECT *, target - CAST(certain * source_size AS DOUBLE) AS rest FROM ratios
), sorted AS (
  SELECT *, CASE WHEN size > 0 THEN CAST(floor((length(bin(size)) - 1) / 2) AS INTEGER) END AS class FROM sized
), strata AS (
  SELECT source, class, CAST(pow(2, class) AS BIGINT) AS weight, CAST(sum(size) AS BIGINT) AS words FROM sorted WHERE size > 0 GROUP BY ALL
), opened AS (
  SELECT s.*, p.rest, p.rest - CAST(coalesce(sum(words) OVER (PARTITION BY s.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS open,
         CAST(sum(weight * words) OVER (PARTITION BY s.source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS below
  FROM strata s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
), chosen AS (
  SELECT *, open > 0 AND CAST(weight AS DOUBLE) * open >= below AS sure FROM opened
), filled AS (
  SELECT *, rest - CAST(sum(CASE WHEN sure THEN words ELSE 0 END) OVER (PARTITION BY source) AS DOUBLE) AS left_words,
         CAST(sum(CASE WHEN sure THEN 0 ELSE weight * words END) OVER (PARTITION BY source) AS DOUBLE) AS w_left
  FROM chosen
), odds AS (
  SELECT *, CASE WHEN sure OR left_words <= 0 THEN 0 ELSE CAST(weight AS DOUBLE) * left_words / w_left END AS p FROM filled
), ranked AS (
  SELECT d.doc_id, d.row, d.source, d.size, t.source_size, t.target, t.certain, coalesce(o.sure, FALSE) AS sure, o.left_words, coalesce(o.p, 0) AS p,
         (CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.row), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sorted d JOIN parts t ON d.source IS NOT DISTINCT FROM t.source
  LEFT JOIN odds o ON d.source IS NOT DISTINCT FROM o.source AND d.class = o.class
), ordered AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM ranked
), summed AS (
  SELECT *, sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS FIRST, doc_id NULLS FIRST, row ROWS UNBOUNDED PRECEDING) AS upto FROM ordered
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0
            ELSE size * (certain + CASE WHEN sure OR (q IS NOT NULL AND upto - size < left_words AND upto - size / 2 <= left_words) THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM summed
"""
