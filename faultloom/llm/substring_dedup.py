"""Substring dedup: prefix-partitioned suffix trees over words.

A window is ``window`` consecutive words of one document; a word is removed if a window that covers it
starts earlier too (smaller id, or the same document and an earlier start). In the suffix tree of the
corpus, suffixes with equal windows are the leaves below one inner node of depth >= window; all leaves
but the first of such a node are repeats. The tree is never held whole, and most suffixes never become
rows, since paths without a branch are merged first:

1. Runs. Neighbouring suffixes whose windows share an anchor (the ``gram`` words with the smallest hash
   in the window, the last of equal ones) form a run, some eight suffixes; equal windows have equal
   anchors. Runs whose anchor occurs once hang on no inner node and are pruned, by hashes of the anchor
   alone. A hash that two anchors share can only keep a run that pruning would have dropped.
2. Equal runs. The words of the other runs are sorted; equal runs are one path with several leaves, all
   later of which are decided. Runs whose anchor has one text only are done.
3. Subtrees. What is left are runs that branch: the ends of shared passages, and near copies. Their
   suffixes, each with its ``window`` words, are grouped by prefixes of variable length: suffixes are
   counted by their first word, and only prefixes of more than ``GROUP`` suffixes are lengthened (see
   ``PREFIXES``), at most to the whole window. A task sorts each group by words and reads it in order:
   the common prefix of neighbours is the depth of the inner node above both, and a node of depth >=
   window has more than one leaf. Sorting is Spark's, which spills; one batch is in Python at a time.
4. All leaves but the first of their node become ranges of words to remove.

Steps 2 and 3 compare words, never hashes of them. Hashes (64 bits) choose anchors, prune runs, tell
an anchor with several texts from one with one, and deal rows to tasks.

Scale: equal runs and equal suffixes are merged in each batch before they move, and an anchor sends at
most three rows a task to its pruning, so a passage that a third of all documents share is a few rows a
batch. A text of any length is read in pieces of ``PIECE_WORDS`` words that overlap by a window.

Defined results: a null or empty text has no words and loses none; the digest of no words is that of
the empty string; rows with equal ids are ordered by a hash (64 bits) of their text; of rows equal in
both, the second and later lose all words if they have a window; a null id counts as the smallest value
of its type; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultloom.llm._common import written

WINDOW = 20
GRAM = 5
BATCH_BYTES = 1 << 22  # of text whose runs are merged at once
PIECE_WORDS = 1 << 18  # of a long text in work at once
BATCH_SUFFIXES = 1 << 17  # suffixes merged at once
MOST_SEEN = 1_000_000  # anchors that a task remembers; others only send more rows
#: Words of the prefixes that suffixes are grouped by, and the size of a group beyond which its prefix is lengthened.
PREFIXES = (1, 2, 4, 8)
GROUP = 1 << 16

PROBE, REPEATED, BRANCHING, LATER = range(4)

_GAPS = bytes([0x20, *range(0x09, 0x0E)])
_TO_SPACE = bytes.maketrans(_GAPS, b" " * len(_GAPS))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MASK = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))))


def plain(text: bytes) -> bytes:
    """The words of a text with one space between them."""
    text = text.translate(_TO_SPACE).strip(b" ")
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of a plain text."""
    if not text:
        none = np.zeros(0, np.int64)
        return none, none
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(text)]))


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For the window at each word, the word where its anchor begins. The hash of a word comes from running
    sums of bytes times powers of an odd base, that of a gram from the hashes of its words."""
    n = len(begins) - window + 1
    if n < 1:
        return np.zeros(0, np.int64)
    up, down = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])))
    h = _mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    g = np.zeros(len(h) - gram + 1, np.uint64)
    for j in range(gram):
        g = g * _GRAM_BASE + h[j : len(h) - gram + 1 + j]
    g = _mix(g)
    start = np.arange(n)
    best, at = g[window - gram : window - gram + n], start + window - gram
    for j in range(window - gram - 1, -1, -1):
        less = g[j : j + n] < best
        best, at = np.where(less, g[j : j + n], best), np.where(less, start + j, at)
    return at


def runs(text: bytes, window: int, gram: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(low, high, anchor, words) of the runs of a plain text, in order."""
    begins, ends = word_bounds(text)
    data = np.frombuffer(text, np.uint8)
    for first in range(0, max(0, len(begins) - window + 1), PIECE_WORDS):
        b, e = begins[first : first + PIECE_WORDS + window - 1], ends[first : first + PIECE_WORDS + window - 1]
        at = anchors(data[b[0] : e[-1]], b - b[0], e - b[0], window, gram)
        if not len(at):
            continue
        low = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        high = np.append(low[1:], len(at)) - 1 + window
        spans = (low + first, high + first, b[at[low]], e[at[low] + gram - 1], b[low], e[high - 1])
        for x, y, a, z, begin, end in zip(*(s.tolist() for s in spans), strict=True):
            yield x, y, text[a:z], text[begin:end]


def common_words(a: bytes, b: bytes) -> int:
    """How many leading words two plain texts share: the depth of the inner node above both."""
    if a == b:
        return a.count(b" ") + 1
    depth = 0
    for x, y in zip(a.split(b" "), b.split(b" "), strict=False):
        if x != y:
            break
        depth += 1
    return depth


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about BATCH_BYTES."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_BYTES):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _signed(h: list[int]) -> pa.Array:
    return pa.array(np.array(h, np.uint64).view(np.int64))


def _spread(*keys: int) -> int:
    """A hash that deals rows to tasks."""
    return xxhash.xxh64_intdigest(repr(keys))


def _in_order(batch: pa.RecordBatch, x: int, y: int) -> list[int]:
    """Rows x .. y - 1 in the order of documents (id, row)."""
    ids, row = batch.column(0).slice(x, y - x).to_pylist(), batch.column(1).slice(x, y - x).to_pylist()
    return [x + k for k in sorted(range(y - x), key=lambda k: (ids[k], row[k]))]


def _seated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, id, row, text): id is doc_id without nulls, row tells texts with equal ids apart."""
    kind = dict(docs.dtypes)[id_col]
    lowest = F.lit("") if kind == "string" else F.lit(-(2**63) if kind == "bigint" else -(2**31)).cast(kind)
    doc_id, text = F.col(id_col), F.col(text_col)
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, lowest).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))


def _anchored(kind: str, window: int, gram: int):
    """Step 1, map side: runs by the hash of their anchor. Runs that need no pruning go under a hash of their own."""
    schema = f"id {kind}, row long, low int, high int, h long, r long, state int"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int | None] = {}  # anchor -> its only text so far, None for several
        twice: set[int] = set()  # anchors with one text that has been met again
        for batch in rows:
            texts = _texts(batch.column(2))
            for x, y in _parts(texts):
                found: dict[bytes, tuple[int, int]] = {}
                place, lows, highs, hs, rs, states = [], [], [], [], [], []
                for k in _in_order(batch, x, y):
                    key = (batch.column(0)[k], batch.column(1)[k])
                    for low, high, anchor, words in runs(plain(texts[k]), window, gram):
                        first = found.setdefault(words, (k, low))
                        h, r = xxhash.xxh64_intdigest(anchor), xxhash.xxh64_intdigest(words)
                        if first != (k, low):
                            if first[1] == low and (batch.column(0)[first[0]], batch.column(1)[first[0]]) == key:
                                continue  # a repeated row: the same leaf
                            state = LATER
                        elif h not in seen:
                            state = PROBE
                            if len(seen) < MOST_SEEN:
                                seen[h] = r
                        elif (only := seen[h]) is None:
                            state = BRANCHING
                        elif only == r:
                            # The second occurrence keeps the first from being pruned.
                            state = REPEATED if h in twice else PROBE
                            twice.add(h)
                        else:
                            state, seen[h] = PROBE, None
                            twice.discard(h)
                        place.append(k)
                        lows.append(low)
                        highs.append(high)
                        hs.append(h if state == PROBE else _spread(h, r, k, low))
                        rs.append(r)
                        states.append(state)
                at = pa.array(place, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(lows, pa.int32()), pa.array(highs, pa.int32()),
                     _signed(hs), _signed(rs), pa.array(states, pa.int32())],
                    ["id", "row", "low", "high", "h", "r", "state"],
                )

    return run, schema


def _worded(kind: str):
    """Step 2, map side: the words of the runs that a text has to compare; later equal runs of a batch lose them."""
    schema = f"id {kind}, row long, low int, high int, branching boolean, words binary, h long"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts, todo = _texts(batch.column(2)), batch.column(3)
            for x, y in _parts(texts):
                found: dict[bytes, tuple[int, int]] = {}
                place, lows, highs, branching, shown, hs = [], [], [], [], [], []
                for k in _in_order(batch, x, y):
                    text = plain(texts[k])
                    begins, ends = word_bounds(text)
                    key = (batch.column(0)[k], batch.column(1)[k])
                    for t in todo[k].as_py():
                        low, high = t["low"], t["high"]
                        words = text[begins[low] : ends[high - 1]]
                        first = found.get(words)
                        same = first is not None and first[1] == low and (batch.column(0)[first[0]], batch.column(1)[first[0]]) == key
                        if same and (first[0] != k or not t["branching"]):
                            continue  # a repeated row: the same leaf
                        if first is None or t["branching"]:
                            # A run that branches is known by any of its copies, so those go on too.
                            found.setdefault(words, (k, low))
                            h = xxhash.xxh64_intdigest(words)
                        else:
                            words, h = None, _spread(k, low, int(begins[low]))
                        place.append(k)
                        lows.append(low)
                        highs.append(high)
                        branching.append(t["branching"])
                        shown.append(words)
                        hs.append(h)
                at = pa.array(place, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(lows, pa.int32()), pa.array(highs, pa.int32()),
                     pa.array(branching, pa.bool_()), pa.array(shown, pa.binary()), _signed(hs)],
                    ["id", "row", "low", "high", "branching", "words", "h"],
                )

    return run, schema


def _leaves(kind: str, window: int):
    """Step 2, reduce side, and step 3, map side: runs come sorted by words; of equal ones the first stays,
    and if it branches, its suffixes go on, equal ones of a batch merged."""
    schema = f"id {kind}, row long, low int, high int, suffix binary"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        best: dict[bytes, tuple] = {}
        last = last_leaf = None
        branches = False

        def put(leaf: tuple, high: int, suffix: bytes | None) -> None:
            for column, value in zip(out, (*leaf, high, suffix), strict=True):
                column.append(value)

        def opened(words: bytes, leaf: tuple) -> None:
            begins, ends = word_bounds(words)
            spans = zip(begins[: len(begins) - window + 1].tolist(), ends[window - 1 :].tolist(), strict=True)
            for j, (a, z) in enumerate(spans):
                suffix, here = words[a:z], (leaf[0], leaf[1], leaf[2] + j)
                first = best.setdefault(suffix, here)
                if first == here:
                    continue
                if here < first:
                    best[suffix], here = here, first
                put(here, here[2] + window, None)

        def flushed() -> pa.RecordBatch:
            for suffix, leaf in best.items():
                put(leaf, leaf[2] + window, suffix)
            types = (rows_schema[0], pa.int64(), pa.int32(), pa.int32(), pa.binary())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["id", "row", "low", "high", "suffix"])
            best.clear()
            for c in out:
                c.clear()
            return made

        rows_schema: list[pa.DataType] = []
        for batch in rows:
            rows_schema = [batch.column(0).type]
            columns = [c.to_pylist() for c in batch.columns[:6]]
            for i, row, low, high, branching, words in zip(*columns, strict=True):
                leaf = (i, row, low)
                if words is None:
                    put(leaf, high, None)
                    continue
                if words != last:
                    if last is not None and branches:
                        opened(last, last_leaf)
                    last, last_leaf, branches = words, leaf, branching
                else:
                    branches |= branching
                    if leaf != last_leaf:
                        put(leaf, high, None)
                if len(best) + len(out[0]) >= BATCH_SUFFIXES:
                    yield flushed()
        if last is not None and branches:
            opened(last, last_leaf)
        if rows_schema and (best or out[0]):
            yield flushed()

    return run, schema


def _nodes(kind: str, window: int):
    """Step 3, reduce side: suffixes of whole groups in the order of their words. All leaves but the first of
    an inner node of depth >= window come out."""
    schema = f"id {kind}, row long, low int, high int"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = last_leaf = None
        for batch in rows:
            later = []
            columns = [c.to_pylist() for c in batch.columns[:4]]
            for k, (i, row, low, suffix) in enumerate(zip(*columns, strict=True)):
                leaf = (i, row, low)
                if last is not None and common_words(last, suffix) >= window:
                    if leaf != last_leaf:  # else a repeated row
                        later.append(k)
                else:
                    last, last_leaf = suffix, leaf
            at = pa.array(later, pa.int64())
            low = batch.column(2).take(at)
            high = pa.array(low.to_numpy() + np.int32(window), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), low, high], ["id", "row", "low", "high"])

    return run, schema


def _prefix(words: int) -> Column:
    return F.xxhash64(F.lit(words), F.substring_index(F.col("suffix").cast("string"), " ", words))


def grouped(suffixes: DataFrame, group: int = GROUP, lengths: tuple[int, ...] = PREFIXES) -> DataFrame:
    """The suffixes with ``prefix``, the hash of the shortest prefix (of ``lengths`` words) that at most
    ``group`` suffixes have, or else of the whole suffix. Of each length only the prefixes above the bound
    are kept, one for each ``group`` suffixes at most, and only suffixes below these are counted further."""
    prefix = F.xxhash64(F.lit(0), F.col("suffix"))
    under, every = suffixes, suffixes
    conditions = []
    for n in lengths:
        heavy = written(under.groupBy(_prefix(n).alias(f"p{n}")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group).select(f"p{n}"), "prefixes")
        none = heavy.isEmpty()
        conditions.append((n, none))
        if none:
            break
        marked = heavy.withColumn(f"heavy{n}", F.lit(True))
        every = every.withColumn(f"p{n}", _prefix(n)).join(marked, f"p{n}", "left")
        under = under.withColumn(f"p{n}", _prefix(n)).join(heavy, f"p{n}", "left_semi")
    for n, none in reversed(conditions):
        prefix = _prefix(n) if none else F.when(F.col(f"heavy{n}").isNull(), F.col(f"p{n}")).otherwise(prefix)
    return every.select(*suffixes.columns, prefix.alias("prefix"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(id, row, low, high): ranges of words that repeat earlier ones; ranges may overlap."""
    base = _seated(docs, id_col, text_col).drop("doc_id")
    kind = dict(base.dtypes)["id"]
    ranged = ("id", "row", "low", "high")

    found = base.mapInArrow(*_anchored(kind, window, gram))
    anchor = Window.partitionBy("h")  # at most three rows a task
    found = found.withColumn("n", F.count(F.lit(1)).over(anchor)).withColumn("several", F.min("r").over(anchor) != F.max("r").over(anchor))
    found = found.filter((F.col("state") != PROBE) | (F.col("n") > 1))
    branching = (F.col("state") == BRANCHING) | ((F.col("state") == PROBE) & F.col("several"))
    found = written(found.select(*ranged, branching.alias("branching"), (F.col("state") == LATER).alias("later")), "runs")

    todo = found.filter("not later").groupBy("id", "row").agg(F.collect_set(F.struct("low", "high", "branching")).alias("todo"))
    words = base.join(todo, ["id", "row"]).select("id", "row", "text", "todo").mapInArrow(*_worded(kind))
    words = words.repartition("h").sortWithinPartitions("words", "id", "row", "low")
    leaves = written(words.select("id", "row", "low", "high", "branching", "words").mapInArrow(*_leaves(kind, window)), "leaves")

    suffixes = grouped(leaves.filter("suffix is not null").select("id", "row", "low", "suffix"), group)
    suffixes = suffixes.repartition("prefix").sortWithinPartitions("prefix", "suffix", "id", "row", "low")
    nodes = suffixes.select("id", "row", "low", "suffix").mapInArrow(*_nodes(kind, window))
    decided = found.filter("later").select(*ranged).unionByName(leaves.filter("suffix is null").select(*ranged))
    return decided.unionByName(nodes)


def _merged(ranges: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for r in sorted(ranges, key=lambda r: r["low"]):
        if out and r["low"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r["high"])
        else:
            out.append([r["low"], r["high"]])
    return out


def _keep(window: int, kind: str):
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            place, n, removed, digest, shown = [], [], [], [], []
            columns = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for k, (text, ranges, again, with_text) in enumerate(zip(_texts(batch.column(1)), *columns, strict=True)):
                words = text.split()  # bytes: parts at the six gap bytes and nothing else
                count, size = len(words), len(words) >= window
                for r in reversed(_merged(ranges or [])):
                    del words[r[0] : r[1]]
                kept = b" ".join(words)
                place.append(k)
                n.append(count)
                removed.append(count - len(words))
                digest.append(hashlib.sha256(kept).hexdigest())
                shown.append(kept if with_text else None)
                if again and size:
                    removed[-1], digest[-1] = count, hashlib.sha256(b"").hexdigest()
                    shown[-1] = b"" if with_text else None
            made = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(shown, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), *made], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run, schema


def _judged(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, with_text: bool) -> DataFrame:
    ranges = repeats(docs, id_col, text_col, window, gram).groupBy("id", "row").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    ranges = written(ranges, "ranges")
    base = _seated(docs, id_col, text_col)
    # Rows equal in id and text are one row here, with their number; others don't move for this.
    equal = base.groupBy("id", "row").agg(F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    equal = written(equal, "equal")
    if equal.isEmpty():
        rows = base.withColumn("again", F.lit(False))
    else:
        single = base.join(equal, ["id", "row"], "left_anti").withColumn("again", F.lit(False))
        several = base.join(equal, ["id", "row"]).dropDuplicates(["id", "row"]).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        named = F.when(F.col("k") >= F.col("nulls"), F.col("id")).alias("doc_id")
        rows = single.unionByName(several.select(named, "id", "row", "text", (F.col("k") > 0).alias("again")))
    joined = rows.join(ranges, ["id", "row"], "left").withColumn("with_text", F.lit(with_text))
    return joined.select("doc_id", "text", "ranges", "again", "with_text").mapInArrow(*_keep(window, dict(docs.dtypes)[id_col]))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""
    return _judged(docs, id_col, text_col, window, gram, False).drop("kept")


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): with the words that are left, one space between them."""
    return _judged(docs, id_col, text_col, window, gram, True)
