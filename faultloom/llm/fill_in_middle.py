"""Fill-in-the-middle: documents cut at unit boundaries and laid out with sentinels, or left plain.

A table-driven automaton over bytes reads all texts of a batch in one scan. Its states know whether
the last byte ended a gap or a word and how much of a sentinel has just passed; each transition emits whether
a unit begins, whether a code point begins (UTF-8 continuation bytes don't) and whether a sentinel ends. The
state after two bytes depends on nothing before them, so the stream is scanned in slices side by side, each
after a run-up of two bytes. A second pass over the emitted counts locates the cuts and the lengths in code points.

Units are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``: a word with the white space before it,
or white space at the end. Draws are the first four 8-digit groups of sha256("seed:id"), so they depend
on the row alone.

Defined results: a null text counts as empty; an empty text, or one that holds a sentinel, stays plain; a null
id draws as an empty one; equal rows get equal results; an empty table gives an empty result; other columns
are ignored. Memory: texts are taken ``BATCH_BYTES`` at a time, a longer text by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

BATCH_BYTES = 8 << 20
SLICE = 256
RUN_UP = 2
EDGE = 0xFF  # no byte of UTF-8; stands before each text

# States: at a text's start, in a gap, in a word, in a word after "<", in a word after "<" and a sentinel's letter.
START, GAP, WORD, OPEN, LETTER = range(5)
# Classes of bytes.
C_EDGE, C_GAP, C_OPEN, C_LETTER, C_CLOSE, C_MORE, C_OTHER = range(7)
# What a transition emits.
UNIT, POINT, SENTINEL = 1, 2, 4


def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each byte, next state and emission by state * 8 + class)."""
    classes = np.full(256, C_OTHER, np.uint8)
    classes[0x80:0xC0] = C_MORE
    classes[[0x20, *range(0x09, 0x0E)]] = C_GAP
    classes[ord("<")], classes[ord(">")], classes[EDGE] = C_OPEN, C_CLOSE, C_EDGE
    classes[[ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]] = C_LETTER
    follow, emit = np.zeros(5 * 8, np.uint8), np.zeros(5 * 8, np.uint8)
    for state in range(5):
        for kind in range(7):
            at = state * 8 + kind
            if kind == C_EDGE:
                follow[at] = START
                continue
            emit[at] = 0 if kind == C_MORE else POINT
            if kind == C_GAP:
                follow[at] = GAP
                emit[at] |= 0 if state == GAP else UNIT
                continue
            emit[at] |= UNIT if state == START else 0
            follow[at] = OPEN if kind == C_OPEN else LETTER if kind == C_LETTER and state == OPEN else WORD
            if kind == C_CLOSE and state == LETTER:
                emit[at] |= SENTINEL
    return classes, follow, emit


_CLASSES, _FOLLOW, _EMIT = _machine()


def scan(stream: np.ndarray) -> np.ndarray:
    """What each byte's transition emits; the stream begins with an edge."""
    kinds = _CLASSES[stream]
    slices = -(-len(kinds) // SLICE)
    laid = np.full(slices * SLICE, C_OTHER, np.uint8)
    laid[: len(kinds)] = kinds
    laid = laid.reshape(slices, SLICE)
    state = np.full(slices, START, np.uint8)
    for j in range(SLICE - RUN_UP, SLICE):  # the end of the slice before
        state[1:] = _FOLLOW[state[1:] * 8 + laid[:-1, j]]
    columns, out = np.ascontiguousarray(laid.T), np.empty((SLICE, slices), np.uint8)
    for j in range(SLICE):
        at = state * 8 + columns[j]
        np.take(_EMIT, at, out=out[j])
        state = _FOLLOW[at]
    return np.ascontiguousarray(out.T).reshape(-1)[: len(kinds)]


class Cuts:
    """Units, sentinels and cut places of the texts of a batch."""

    def __init__(self, texts: list[bytes]):
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.begin = np.cumsum(lengths + 1) - lengths  # of each text in the stream, after its edge
        self.end = self.begin + lengths
        edge = bytes([EDGE])
        self.emitted = scan(np.frombuffer(edge + edge.join(texts), np.uint8))
        self.places = np.flatnonzero(self.emitted & UNIT)  # of all units
        self.first = np.searchsorted(self.places, self.begin)
        self.units = np.searchsorted(self.places, self.end) - self.first
        marks = np.flatnonzero(self.emitted & SENTINEL)
        self.marked = np.searchsorted(marks, self.end) > np.searchsorted(marks, self.begin)

    def after(self, units: np.ndarray) -> np.ndarray:
        """The place where as many units of each text have ended."""
        at = np.minimum(self.first + units, max(0, len(self.places) - 1))
        begun = self.places[at] if len(self.places) else self.end
        return np.where(units < self.units, begun, self.end)

    def points(self, bounds: np.ndarray) -> np.ndarray:
        """Code points between the bounds of each row (texts x bounds), which ascend from row to row."""
        ascending = bounds.reshape(-1)
        inside = np.append(((self.emitted & POINT) > 0).astype(np.uint8), np.uint8(0))
        sums = np.add.reduceat(inside, ascending, dtype=np.int64)
        sums[:-1][ascending[1:] == ascending[:-1]] = 0  # reduceat gives an empty range its first element
        return sums.reshape(bounds.shape)[:, :-1]


def _form(n: np.ndarray, marked: np.ndarray, draws: list[np.ndarray], rate: int, spm: int) -> np.ndarray:
    """0 plain, 1 psm, 2 spm."""
    return np.where((n == 0) | marked | (draws[2] % 100 >= rate), 0, np.where(draws[3] % 100 < spm, 2, 1))


def _laid_out(texts: list[bytes], draws: list[np.ndarray], rate: int, spm: int) -> tuple[list, ...]:
    cuts = Cuts(texts)
    n = cuts.units
    a, b = (draws[k] % (n + 1) for k in (0, 1))
    low, high = cuts.after(np.minimum(a, b)), cuts.after(np.maximum(a, b))
    form = _form(n, cuts.marked, draws, rate, spm)
    points = cuts.points(np.stack([cuts.begin, low, high, cuts.end], axis=1))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    outputs = []
    for text, f, i, j in zip(texts, form.tolist(), (low - cuts.begin).tolist(), (high - cuts.begin).tolist(), strict=True):
        if f == 0:
            outputs.append(text)
        elif f == 1:
            outputs.append(b"".join((p, text[:i], s, text[j:], m, text[i:j])))
        else:
            outputs.append(b"".join((s, text[j:], p, text[:i], m, text[i:j])))
    plain = form == 0
    return n, [("plain", "psm", "spm")[f] for f in form.tolist()], pa.array(points[:, 0], mask=plain), pa.array(points[:, 1], mask=plain), outputs


def draws(id_col: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of sha256("seed:id") as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output (the whole text laid out).

    ``rate`` percent of the documents are cut, ``spm`` percent of these with the suffix first.
    """
    kind = dict(docs.dtypes)[id_col]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(1).cast(pa.binary())
            sizes = np.cumsum([len(t) for t in texts.to_pylist()] or [0])
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, side="right")))
                part = batch.slice(at, stop - at)
                drawn = [part.column(2 + k).to_numpy() for k in range(4)]
                n, form, prefix, middle, outputs = _laid_out(texts.slice(at, stop - at).to_pylist(), drawn, rate, spm)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(form), prefix, middle, pa.array(outputs, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                at = stop

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col(id_col), seed))])
    return rows.mapInArrow(batches, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; it holds no sentinel of its own unless it is plain."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(a) + len(second) + 1)
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, F.substr(rest, F.length(b) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_2, prefix_2, middle_2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_2, middle_2, suffix_2)).otherwise(output)


#: The contract's rows in DuckDB: units by one regular expression, parts as list slices.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT doc_id, t, len(us) AS n, form, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
