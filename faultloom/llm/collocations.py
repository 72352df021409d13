"""Phrase collocations: frequent word sequences that hold together, mined for each language.

Texts are cut into pieces at sentence marks and line ends, pieces into words. Each task reads its texts in shards
and builds for a language's words in a shard a generalised suffix automaton of bounded depth: a
node stands for a word sequence, with its stem (the sequence less its last word, the node it is reached from),
its suffix link (less its first word) and the size of its endpos set, the number of places it ends at. A sequence
whose count equals that of a one word longer sequence linked to it has the same endpos set and is in the
same state. The sequences of all states are counted over the shards by Spark.

Lengths are counted one after the other: sequences of one and two words in a first pass, then those of
each further length, of which a shard only keeps nodes whose stem and suffix link may both be frequent
in the whole corpus. What may be frequent stands in a bit table of fixed size (``filter_bits``, two bits a
sequence), made from the exact counts: it never misses a frequent sequence; the more of its bits are set, the more
infrequent ones are shuffled and then dropped by their exact count.

Scores are exact: integers in decimals of 38 digits, which hold counts below 10^14.

Defined results: a null text counts as empty, a null language as ``und``; equal rows count as often as they stand there; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultloom.llm._common import LOWER, UPPER, written

NO_LANG = "und"
MARKS = ".,;:!?\n\x0b\x0c\r"
SHARD_WORDS = 1_000_000
SHARD_VOCABULARY = 300_000
TEXT_BYTES = 1 << 20
ROWS_AT_ONCE = 256
ROWS_OUT = 50_000
SLICES = 32  # of a language, in the first of two steps to its highest ranks

_CUT = b"\xff"  # no byte of UTF-8
_BYTES = bytes.maketrans((UPPER + "\t" + MARKS).encode(), (LOWER + " ").encode() + _CUT * len(MARKS))


class Automaton:
    """The suffix automaton of a shard's words in one language, to a bounded depth.

    ``words`` are codes from 1; 0 ends a piece. Level d has the sequences of d words: ``stem`` and ``link``
    are places in level d - 1, ``last`` is the code of the last word, ``count`` the size of the endpos set.
    """

    def __init__(self, words: np.ndarray, vocabulary: int):
        self.count = np.bincount(words, minlength=vocabulary + 1)
        self.count[0] = 0
        self.last = np.arange(vocabulary + 1)
        self.stem = self.link = None
        self.ends = np.flatnonzero(words)  # places where a sequence of this level begins, and which it is
        self.states = words[self.ends].astype(np.int64)

    def deeper(self, kept: np.ndarray | None = None) -> Automaton:
        """The next level; ``kept`` says of each sequence of this one whether its extensions are wanted."""
        level = object.__new__(Automaton)
        begins = np.flatnonzero(self.ends[1:] == self.ends[:-1] + 1)
        if kept is not None:
            begins = begins[kept[self.states[begins]] & kept[self.states[begins + 1]]]
        size = len(self.count)
        pairs, level.states, level.count = np.unique(self.states[begins] * size + self.states[begins + 1], return_inverse=True, return_counts=True)
        level.stem, level.link = pairs // size, pairs % size
        level.last = self.last[level.link]
        level.ends = self.ends[begins]
        return level


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


class _Shard:
    def __init__(self):
        self.codes = _Vocabulary({_CUT: 0})
        self.words: dict[str, list[np.ndarray]] = {}
        self.n = 0

    def add(self, lang: str, texts: list[bytes]) -> None:
        at = 0
        while at < len(texts):
            taken, size = at, 0
            while at < len(texts) and (at == taken or size + len(texts[at]) <= TEXT_BYTES):
                size += len(texts[at])
                at += 1
            found = (_CUT.join(texts[taken:at]).translate(_BYTES).replace(_CUT, b" " + _CUT + b" ") + b" " + _CUT).split()
            self.words.setdefault(lang, []).append(np.fromiter(map(self.codes.__getitem__, found), np.int32, len(found)))
            self.n += len(found)

    def full(self) -> bool:
        return self.n >= SHARD_WORDS or len(self.codes) >= SHARD_VOCABULARY


def _rotated(h: np.ndarray) -> np.ndarray:
    return (h << np.uint64(5)) | (h >> np.uint64(59))


def _sequence_hash(phrase: Column, lang: Column) -> Column:
    """64 bits of a sequence: hashes of its words, folded; the tasks compute the same from their codes."""
    folded = F.aggregate(F.split(phrase, " "), F.lit(0).cast("long"), lambda h, w: F.shiftleft(h, 5).bitwiseOR(F.shiftrightunsigned(h, 59)).bitwiseXOR(F.xxhash64(w)))
    return folded.bitwiseXOR(F.xxhash64(lang))


def _bits(counts: DataFrame, length: int, filter_bits: int) -> np.ndarray:
    """The bit table of the frequent sequences of a length: at most filter_bits / 64 rows come to the driver."""
    h = _sequence_hash(F.col("phrase"), F.col("lang"))
    mask = F.lit(filter_bits - 1).cast("long")
    probes = F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))
    bit = counts.filter(F.col("k") == length).select(F.explode(probes).alias("bit"))
    cells = bit.groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(filter_bits // 64, np.uint64)
    table[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return table


def _told(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = np.uint64(64 * len(table) - 1)
    out = np.ones(len(h), bool)
    for probe in (h & mask, (h >> np.uint64(32)) & mask):
        out &= (table[probe >> np.uint64(6)] >> (probe & np.uint64(63))) & np.uint64(1) == 1
    return out


def _sequences(shard: _Shard, length: int, table: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """lang, phrase, k (its words), f: sequences of one and two words and, as the empty phrase, the number of words;
    or with a bit table those of ``length`` words whose stem and link it holds."""
    spelled = pa.array(list(shard.codes), pa.binary())
    hashes = None if table is None else np.fromiter((xxhash.xxh64_intdigest(w, seed=42) for w in shard.codes), np.uint64, len(shard.codes))

    def made(lang: str, phrases: pa.Array, k: int, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(phrases), ROWS_OUT):
            part = phrases.slice(at, ROWS_OUT)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part)), part.cast(pa.string()), pa.array(np.full(len(part), k, np.int32)), pa.array(f[at : at + ROWS_OUT], pa.int64())],
                ["lang", "phrase", "k", "f"],
            )

    for lang, parts in shard.words.items():
        level = Automaton(np.concatenate(parts), len(shard.codes) - 1)
        phrases = spelled
        if table is None:
            here = np.flatnonzero(level.count)
            yield from made(lang, pa.array([b""], pa.binary()), 0, level.count.sum(keepdims=True))
            yield from made(lang, spelled.take(pa.array(here)), 1, level.count[here])
            level = level.deeper()
            yield from made(lang, pc.binary_join_element_wise(spelled.take(pa.array(level.stem)), spelled.take(pa.array(level.last)), b" "), 2, level.count)
            continue
        h = hashes
        for k in range(2, length + 1):
            kept = _told(table, h ^ np.uint64(xxhash.xxh64_intdigest(lang.encode(), seed=42))) if k == length else None
            level = level.deeper(kept)
            h = _rotated(h[level.stem]) ^ hashes[level.last]
            phrases = pc.binary_join_element_wise(phrases.take(pa.array(level.stem)), spelled.take(pa.array(level.last)), b" ")
        yield from made(lang, phrases, length, level.count)


def _counted(rows: DataFrame, length: int, table: np.ndarray | None) -> DataFrame:
    """lang, phrase, k, f over all rows (lang, text)."""
    shared = None if table is None else rows.sparkSession.sparkContext.broadcast(table)

    def batches(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bits = _Shard(), None if shared is None else shared.value
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in arrived for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            langs = batch.column(0).dictionary_encode()
            codes, texts = langs.indices.to_numpy(), batch.column(1).cast(pa.binary())
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                shard.add(lang, texts.take(pa.array(np.flatnonzero(codes == k))).to_pylist())
            if shard.full():
                yield from _sequences(shard, length, bits)
                shard = _Shard()
        yield from _sequences(shard, length, bits)

    found = rows.mapInArrow(batches, "lang string, phrase string, k int, f long")
    return found.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))


def frequent_sequences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10, filter_bits: int = 1 << 26) -> DataFrame:
    """lang, phrase, k (words, 1 to max_words), f of all sequences with f >= min_count, and for each language one
    row of k = 0, whose f is its number of words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = written(_counted(rows, 2, None).filter((F.col("f") >= min_count) | (F.col("k") == 0)), "sequences")
    for length in range(3, max_words + 1):
        more = _counted(rows, length, _bits(kept, length - 1, filter_bits))
        kept = kept.unionByName(written(more.filter(F.col("f") >= min_count), "sequences"))
    return kept


def _first(phrase: str, n: Column) -> Column:
    """The first n words of a phrase; the last -n if n is negative."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), n)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10, cover: int = 50, top: int = 2000, filter_bits: int = 1 << 26,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to max_words words of each language.

    a is a phrase's count, l and r those of its two parts at the cut that scores lowest (of equals the first), the score
    floor(1000000 a a / (l r)). A phrase goes if a longer one that contains it has at least ``cover`` percent of its count:
    the longer one's stem and suffix link, over all lengths, are what it contains.
    """
    counts = frequent_sequences(docs, text_col, lang_col, max_words, min_count, filter_bits)
    phrases = counts.filter(F.col("k") >= 2).select("lang", "phrase", "k", F.col("f").alias("a"))
    part = counts.filter(F.col("k") >= 1).select(F.col("lang"), F.col("phrase").alias("part"), "f")

    # Every cut of a phrase has a frequent left and right part, as both are at least as frequent as the phrase.
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k")
    left = _first("phrase", F.col("cut")).alias("left")
    right = _first("phrase", F.col("cut") - F.col("k")).alias("right")
    cuts = cuts.select("lang", "phrase", "a", "cut", left, right)
    cuts = cuts.join(part.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(cast(a as decimal(14,0)) * cast(a as decimal(14,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(14,0)) * cast(r as decimal(14,0)))")
    lowest = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "cut", "l", "r").alias("at")).groupBy("lang", "phrase", "a").agg(F.min("at").alias("at"))

    inner = lambda p: F.array(_first(p, 1 - F.col("k")), _first(p, F.col("k") - 1))
    within = phrases.filter("k > 2").select("lang", F.explode(inner("phrase")).alias("phrase"), (F.col("k") - 1).alias("k"), F.col("a").alias("longer"))
    around = within
    for _ in range(max_words - 3):
        within = within.filter("k > 2").select("lang", F.explode(inner("phrase")).alias("phrase"), (F.col("k") - 1).alias("k"), "longer")
        around = around.unionByName(within)
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = lowest.join(around, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("a") * cover, F.lit(True)))

    found = alone.select("lang", "phrase", "a", "at.l", "at.r", "at.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SLICES))).orderBy(*order)
    best = found.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    total = counts.filter(F.col("k") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The contract's rows in DuckDB.
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM words
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM words),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2 AND f >= 10),
cuts AS (
  SELECT lang, k, phrase, a, 1 AS cut, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM cand
  UNION ALL SELECT lang, k, phrase, a, 2, array_to_string(w[1:2], ' '), w[3] FROM cand WHERE k = 3),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a::HUGEINT * c.a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lp AND x.k = c.cut JOIN counts y ON y.lang = c.lang AND y.phrase = c.rp AND y.k = c.k - c.cut),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
around AS (
  SELECT lang, phrase, max(longer) AS longer FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a AS longer FROM cand WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM cand WHERE k = 3) GROUP BY ALL),
ranked AS (
  SELECT o.*, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, o.phrase) AS rank
  FROM low o LEFT JOIN around r ON r.lang = o.lang AND r.phrase = o.phrase WHERE coalesce(r.longer * 100 < o.a * 50, true))
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t USING (lang) WHERE r.rank <= 2000
"""
