"""Quality rules at host level [native].

Every document is measured, the failures of its host are aggregated, the host's failure rate is
shrunk with an empirical beta prior fitted to all hosts by the method of moments, and the host's
verdict is joined back: a document is kept if it passes the base rules itself and its host doesn't
stand out. A host does if its failure rate lies above the prior's mean by more than ``min_margin``, with a
posterior chance of ``CERTAIN`` standard deviations (95 of 100; by the normal form of the posterior beta). What counts is
what hosts have in common: a corpus whose hosts are alike loses none of them, however strict the rules
are, and a small host needs a far higher rate than a large one.

Defined results: a null or empty text has zero words and fails the base rules; a null host is a
host of its own; equal rows are separate documents; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultloom.llm._common import WORD, words, written

SYMBOLS = "#*$%&|<>"

#: Prior strength (pseudo-documents) is kept within these bounds.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1e6

#: A chance of 95 of 100 in standard deviations, on one side.
CERTAIN = 1.645


def _covered(positions: Column, span: int) -> Column:
    """How many of the places p .. p + span - 1 the sorted positions cover."""
    last = F.lit(span)
    gaps = F.zip_with(
        positions,
        F.slice(positions, 2, F.greatest(F.size(positions) - 1, F.lit(0))),
        lambda here, after: F.coalesce(F.least(after - here, last), last),
    )
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long).

    Repeats are found inside the row: the hashes of all three-word windows say whether the text
    has any repeat at all, and only texts that do sort (hash, position) to find where.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).alias("host"),
        words(F.col(text_col)).alias("w"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    base = base.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("w") - 3),
                lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)),
            ),
        ).alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    base = base.withColumn(
        "ranked",
        F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("windows")
    neighbours = F.transform(
        "ranked",
        lambda x, j: F.when(
            F.coalesce(F.get("ranked", j - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get("ranked", j + 1)["h"] == x["h"], F.lit(False)),
            x["i"],
        ),
    )
    base = base.withColumn("again", F.sort_array(F.array_compact(neighbours))).drop("ranked")
    return base.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(_covered(F.col("again"), 3), F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def host_verdicts(measured: DataFrame, failed: Column, min_margin: float = 0.15) -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_kept): failure rates shrunk to what hosts have in common.

    The prior Beta(a, b) has the mean m and variance v of the hosts' raw rates; its strength
    m (1 - m) / v - 1 is kept in [MIN_STRENGTH, MAX_STRENGTH]. Only one row of moments reaches the driver.
    """
    hosts = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    mean = moments["m"] if moments["m"] is not None else 0.0
    spread = mean * (1 - mean)
    strength = spread / moments["v"] - 1 if moments["v"] else MAX_STRENGTH
    strength = min(max(strength, MIN_STRENGTH), MAX_STRENGTH)
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    rate = F.col("host_rate")
    least = rate - CERTAIN * F.sqrt(rate * (1 - rate) / (F.col("n_docs") + F.lit(strength + 1)))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", least <= mean + min_margin)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_symbol_percent: int = 10,
    max_dup_lines: int = 10,
    min_margin: float = 0.15,
) -> DataFrame:
    """Measures, base_failed, and kept for each document.

    The base rules decide over the document alone; a host's rate counts documents that fail any
    rule: the base rules, symbols over ``max_symbol_percent`` of the word characters, or more than
    ``max_dup_lines`` duplicate lines. The measures are written once (they are narrow), then read
    for the host rates and for the result.
    """
    measured = written(measure(docs, id_col, text_col, host_col), "quality").withColumn(
        "base_failed",
        (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
    )
    failed = (
        F.col("base_failed")
        | (100 * F.col("n_symbols") > max_symbol_percent * F.col("word_chars"))
        | (F.col("n_dup_lines") > max_dup_lines)
    )
    verdicts = host_verdicts(measured, failed, min_margin).select(F.col("host").alias("of_host"), "host_rate", "host_kept")
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("host_kept"), F.lit(True))).alias("kept"),
    )


ORACLE_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), base AS (
  SELECT row_id, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, w
  FROM split
), windows AS (
  SELECT row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT row_id, w, unnest(range(1, n_words - 1)) AS i FROM base)
), repeated AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT row_id, CAST(count(DISTINCT p) AS BIGINT) AS n_repeat_words
  FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY row_id
), measured AS (
  SELECT b.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words,
         n_words < 50 OR 100 * coalesce(c.n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM base b LEFT JOIN covered c USING (row_id)
), hosts AS (
  SELECT source, count(*) AS n, sum(CASE WHEN base_failed OR 100 * n_symbols > 10 * word_chars OR n_dup_lines > 10 THEN 1 ELSE 0 END) AS f
  FROM measured GROUP BY source
), moments AS (
  SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts
), prior AS (
  SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 1e6 END AS k FROM moments
), verdicts AS (
  SELECT source, r - 1.645::DOUBLE * sqrt(r * (1 - r) / (n + k + 1)) <= m + 0.15::DOUBLE AS host_kept FROM (SELECT *, (f + m * k) / (n + k) AS r FROM hosts, prior)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_kept AS kept
FROM measured d JOIN verdicts v ON d.source IS NOT DISTINCT FROM v.source
"""
