"""Language ID: a byte convolutional network, trained in numpy on labelled text.

Filters of widths 2, 3 and 4 run over the bytes of a fixed-length window; each filter's largest
response (max pooling, rectified) feeds a softmax over languages. A text is cut into consecutive
windows of ``WINDOW`` bytes, all of them are judged, and the text's probabilities are the mean over
its windows, weighted by their bytes.

Bytes are symbols, so a filter's response is a sum of table entries. For judging, the tables of
neighbouring bytes are added up in advance (65,536 rows), and a window costs a few look-ups a byte.

Training uses a bounded sample (``max_docs_per_language`` rows for each of at most ``MAX_LANGUAGES``
languages, ``WINDOWS_PER_DOC`` windows of each), picked by a hash of the id, so that the bound holds
however large the table is. Only text and lang of those rows are learned from.

Defined results: a null text, or one without a letter, is ``und`` with score 0; equal texts get equal
results; an empty table, or one without labels, gives ``und`` for every row; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
MAX_LANGUAGES = 256
WINDOWS_PER_DOC = 4
PAD = 0
NEVER = np.float32(-1e4)
ROWS_AT_ONCE = 256  # windows: three blocks of filter responses of 4 MB
TEXTS_AT_ONCE = 512


def cut_windows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, bytes in each, index of the text of each); a NUL in a text reads as a space."""
    lengths = np.fromiter((len(b) for b in raw), np.int64, len(raw))
    per_text = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(raw)), per_text)
    first = np.concatenate(([0], np.cumsum(per_text)))
    laid = np.full(int(first[-1]) * WINDOW, PAD, np.uint8)
    data = np.frombuffer(b"".join(raw), np.uint8)
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(raw) else lengths
    laid[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW - begins, lengths)] = np.where(data == PAD, 32, data)
    inside = np.arange(int(first[-1])) - first[owner]
    return laid.reshape(-1, WINDOW), np.minimum(WINDOW, lengths[owner] - inside * WINDOW), owner


class ByteConvNet:
    """Multi-width filters, max pooling and softmax."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.filters = [(rng.standard_normal((w, 256, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, PAD] = NEVER
        self.out = (rng.standard_normal((len(WIDTHS) * FILTERS, len(labels))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        pooled, where = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            response = sum(f[j][x[:, j : x.shape[1] - w + 1 + j]] for j in range(w))
            at = response.argmax(axis=1)
            where.append(at)
            pooled.append(np.maximum(np.take_along_axis(response, at[:, None], axis=1)[:, 0], 0))
        return np.concatenate(pooled, axis=1), where

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.05, seed: int = 7) -> None:
        """Cross entropy, AdaGrad; the gradient of a filter goes to the bytes of its largest response."""
        rng = np.random.default_rng(seed)
        seen = [np.full_like(f, 1e-3) for f in self.filters]
        seen_out, seen_bias = np.full_like(self.out, 1e-3), np.full_like(self.bias, 1e-3)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                xb = x[rows]
                h, where = self._pooled(xb)
                p = _softmax(h @ self.out + self.bias)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                g_out, g_bias, g_h = h.T @ p, p.sum(axis=0), (p @ self.out.T) * (h > 0)
                for k, w in enumerate(WIDTHS):
                    g = g_h[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        symbol = np.take_along_axis(xb, where[k] + j, axis=1)
                        grad = np.zeros((256, FILTERS), np.float32)
                        np.add.at(grad, (symbol, np.arange(FILTERS)[None, :]), g)
                        grad[PAD] = 0
                        seen[k][j] += grad * grad
                        self.filters[k][j] -= rate * grad / np.sqrt(seen[k][j])
                seen_out += g_out * g_out
                seen_bias += g_bias * g_bias
                self.out -= rate * g_out / np.sqrt(seen_out)
                self.bias -= rate * g_bias / np.sqrt(seen_bias)

    def tables(self) -> list[np.ndarray]:
        """Responses by pairs of neighbouring bytes: of width 2; of width 3 and its last byte; of both halves of width 4."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        two, three, four = self.filters
        return [pair(two[0], two[1]), pair(three[0], three[1]), three[2], pair(four[0], four[1]), pair(four[2], four[3])]

    def probabilities(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        two, three, third, four, fourth = tables
        out = np.empty((len(x), len(self.labels)), np.float32)
        for at in range(0, len(x), ROWS_AT_ONCE):
            xb = x[at : at + ROWS_AT_ONCE]
            pairs = (xb[:, :-1].astype(np.int32) << 8) | xb[:, 1:]
            h = [np.take(two, pairs, axis=0).max(axis=1)]
            h.append((np.take(three, pairs[:, :-1], axis=0) + np.take(third, xb[:, 2:], axis=0)).max(axis=1))
            h.append((np.take(four, pairs[:, :-2], axis=0) + np.take(fourth, pairs[:, 2:], axis=0)).max(axis=1))
            out[at : at + len(xb)] = _softmax(np.maximum(np.concatenate(h, axis=1), 0) @ self.out + self.bias)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Rows that training never sees: crc32 of the id as text is a multiple of ``folds``."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(folds)) == 0, F.lit(False))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs_per_language: int = 1000
) -> ByteConvNet | None:
    """A network for the languages of the rows outside the held-out fold; None if there are none.

    At most max_docs_per_language rows of each language, by the hash of their id, are learned from. More than
    MAX_LANGUAGES languages are an error, as their samples and filters are held on the driver.
    """
    narrow = docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    narrow = narrow.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    labels = sorted(r["lang"] for r in narrow.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect())
    if len(labels) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not labels:
        return None
    one = lambda lang: narrow.filter(F.col("lang") == lang).orderBy(F.xxhash64("id"), "id").limit(max_docs_per_language)
    picked = reduce(DataFrame.union, [one(lang) for lang in labels]).distinct()
    step = F.greatest(F.length("text") - WINDOW, F.lit(0)) / F.lit(WINDOWS_PER_DOC - 1)
    cuts = [F.substr(F.col("text"), (F.floor(step * k) + 1).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS_PER_DOC)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    rows = texts.join(F.broadcast(picked), ["id", "lang"]).select("lang", F.array_distinct(F.array(*cuts)).alias("cuts"))
    rows = rows.orderBy(F.xxhash64("lang", "cuts"), "lang", "cuts").limit(max_docs_per_language * len(labels)).collect()  # ids may repeat
    samples = sorted((r["lang"], c) for r in rows for c in r["cuts"] if c)
    if not samples:
        return None
    x = cut_windows([c.encode("utf-8", "surrogatepass")[:WINDOW] for _, c in samples])[0]
    net = ByteConvNet(labels)
    net.fit(x, np.array([labels.index(lang) for lang, _ in samples]))
    return net


def judge(text: Column, net: ByteConvNet | None, docs: DataFrame, batch_bytes: int = 1 << 18) -> Column:
    """A struct (lang, score) for each text: its language and that language's mean probability."""
    letters = F.when(text.rlike(r"\p{L}"), text)
    if net is None:
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast((net, net.tables()))

    def judged(column: pa.Array) -> pa.Array:
        network, tables = model.value
        # A text's bytes are judged in blocks, so a very long text needs no more memory than others.
        texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
        sums, weight = np.zeros((len(texts), len(network.labels))), np.zeros(len(texts))
        blocks, owners, size = [], [], 0
        pieces = ((k, t[at : at + batch_bytes]) for k, t in enumerate(texts) for at in range(0, len(t), batch_bytes))
        for k, piece in itertools.chain(pieces, [(-1, b"")]):
            if k >= 0:
                blocks.append(piece)
                owners.append(k)
                size += len(piece)
            if blocks and (size >= batch_bytes or k < 0):
                x, n, owner = cut_windows(blocks)
                p = network.probabilities(x, tables) * n[:, None]
                np.add.at(sums, np.asarray(owners)[owner], p)
                np.add.at(weight, np.asarray(owners)[owner], n)
                blocks, owners, size = [], [], 0
        best = sums.argmax(axis=1) if len(texts) else np.zeros(0, np.int64)
        score = np.where(weight > 0, sums[np.arange(len(texts)), best] / np.maximum(weight, 1), 0.0)
        named = [network.labels[b] if w else "und" for b, w in zip(best, weight, strict=True)]
        return pa.StructArray.from_arrays([pa.array(named, pa.string()), pa.array(np.clip(score, 0.0, 1.0))], ["lang", "score"])

    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:  # a few texts of it at a time are copied
            yield pa.concat_arrays([judged(column.slice(at, TEXTS_AT_ONCE)) for at in range(0, max(1, len(column)), TEXTS_AT_ONCE)])

    return F.arrow_udf(batches, "lang string, score double")(letters)


def identify(docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (mean probability of lang_pred) for every row, over whole texts."""
    judged = docs.select(F.col(id_col).alias("doc_id"), judge(F.col(text_col), net, docs).alias("_judged"))
    return judged.select("doc_id", F.col("_judged.lang").alias("lang_pred"), F.col("_judged.score").alias("score"))


def keep_known(docs: DataFrame, net: ByteConvNet | None, text_col: str = "text", min_score: float = 0.35) -> DataFrame:
    """The rows whose text is in a learned language with at least ``min_score``; und goes."""
    judged = docs.withColumn("_judged", judge(F.col(text_col), net, docs))
    return judged.filter((F.col("_judged.lang") != "und") & (F.col("_judged.score") >= min_score)).drop("_judged")
