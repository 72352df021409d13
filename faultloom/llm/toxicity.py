"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: density and strength of lexicon hits (as written and with obfuscation undone),
hits near a second-person pronoun, second-person density, capitals, exclamation marks, other
punctuation, obfuscated words, stretched letters, and the length. The lexicon is learned from
labelled rows: words and word beginnings that are far more frequent in toxic ones.

Training uses bounded samples of the labelled rows, picked by a hash of the id: at most
``max_lexicon_rows`` for each label for the lexicon and ``max_rows`` for each label for the trees; a
quarter of those is set aside for the calibration. All other work is over all rows.

Defined results: a null text counts as empty and gets the score of an empty text; without labels of
both kinds every score is the share of toxic labels (0 without any); several labels of one id count as
toxic if one is; equal texts get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIXES = (4, 5, 6)
MAX_LEXICON = 4000
MIN_TOXIC_ROWS = 4
MIN_LOG_ODDS = 3.0
NEAR = 5
MAX_CACHE = 300_000

# Second-person pronouns of the corpus's languages.
SECOND_PERSON = frozenset(
    "you your yours yourself ya u du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
# Characters that stand for letters in obfuscated words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})

FEATURES = (
    "hit_density", "hits", "strength", "strongest", "near_density", "second_person", "capitals", "capital_words",
    "exclamations", "punctuation", "obfuscated", "hidden_hits", "stretched", "length",
)
_EDGE = "\"'`´“”„«»()[]{}<>,;:!?.…-–—*#%&$~|/\\¡¿"
_STRETCH = re.compile(r"(.)\1\1")
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "!"]] = True


def learned_rows(id_col: Column, folds: int = 3, rest: int = 1) -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo folds, isn't ``rest``."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(folds)) != rest, F.lit(False))


class _Codes(dict):
    """word -> code: strength of the lexicon hit in tenths, then bits; built when first met, bounded."""

    HIT, SECOND, CAPITAL, OBFUSCATED, HIDDEN, STRETCHED = (1 << k for k in range(6))

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def _strength(self, word: str) -> float:
        found = self.lexicon.get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n:
                found = max(found, self.lexicon.get(word[:n] + "+", 0.0))
        return found

    def __missing__(self, raw: str) -> int:
        if len(self) > MAX_CACHE:
            self.clear()
        word = raw.strip(_EDGE)
        low, code = word.lower(), 0
        strength = self._strength(low)
        if strength:
            code |= self.HIT
        if low in SECOND_PERSON:
            code |= self.SECOND
        if len(word) > 1 and word.isupper():
            code |= self.CAPITAL
        if any(c.isalpha() for c in low) and not low.isalpha() and "'" not in low and "@" not in low[1:-1]:
            code |= self.OBFUSCATED
            plain = low.translate(LEET)
            if not strength and (hidden := self._strength(plain)):
                strength = hidden
                code |= self.HIDDEN
        if _STRETCH.search(low):
            code |= self.STRETCHED
            if not strength and (hidden := max(self._strength(_STRETCH.sub(r"\1", low)), self._strength(re.sub(r"(.)\1+", r"\1", low)))):
                strength = hidden
                code |= self.HIDDEN
        code |= int(strength * 10) << 6
        if len(raw) < 64:
            self[raw] = code
        return code


def features(text: str, codes: _Codes) -> np.ndarray:
    words = text.split()
    out = np.zeros(len(FEATURES))
    n = len(words)
    if n:
        code = np.fromiter(map(codes.__getitem__, words), np.int64, n)
        strength = code >> 6
        hit = strength > 0
        count = int(hit.sum())
        second = (code & _Codes.SECOND) > 0
        near = 0
        if count and second.any():
            places = np.flatnonzero(second)
            at = np.flatnonzero(hit)
            k = np.searchsorted(places, at)
            after = np.abs(places[np.minimum(k, len(places) - 1)] - at)
            before = np.abs(at - places[np.maximum(k - 1, 0)])
            near = int((np.minimum(after, before) <= NEAR).sum())
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        out[:6] = count / n, np.log1p(count), strength.sum() / 10 / n, strength.max() / 10, near / n, second.sum() / n
        out[6] = ((raw >= 65) & (raw <= 90)).sum() / len(raw)
        out[7] = ((code & _Codes.CAPITAL) > 0).sum() / n
        out[8] = (raw == 33).sum() / n
        out[9] = _PUNCT[raw].sum() / n
        out[10] = ((code & _Codes.OBFUSCATED) > 0).sum() / n
        out[11] = ((code & _Codes.HIDDEN) > 0).sum() / n
        out[12] = ((code & _Codes.STRETCHED) > 0).sum() / n
        out[13] = np.log1p(n)
    return out


class BoostedTrees:
    """Logistic gradient boosting with trees of fixed depth over binned features."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, min_rows: int = 5, l2: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.min_rows, self.l2 = trees, depth, rate, bins, min_rows, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature and cut of inner nodes, values of leaves

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            inner = (1 << self.depth) - 1
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                best_gain, best_f, best_b = np.zeros(width), np.zeros(width, np.int64), np.full(width, -1)
                for f in range(x.shape[1]):
                    k = (node - first) * (self.bins + 1) + binned[:, f]
                    sums = [np.bincount(k, weights=v, minlength=width * (self.bins + 1)).reshape(width, -1).cumsum(axis=1) for v in (grad, hess, None)]
                    (g, h, n), total = sums, [s[:, -1:] for s in sums]
                    worth = lambda a, b: a * a / (b + self.l2)
                    gain = worth(g, h) + worth(total[0] - g, total[1] - h) - worth(total[0], total[1])
                    gain[(n < self.min_rows) | (total[2] - n < self.min_rows)] = 0
                    gain[:, len(cuts[f]) :] = 0
                    b = gain.argmax(axis=1)
                    g = gain[np.arange(width), b]
                    better = g > best_gain + 1e-12
                    best_gain, best_f, best_b = np.where(better, g, best_gain), np.where(better, f, best_f), np.where(better, b, best_b)
                for w in np.flatnonzero(best_b >= 0):
                    feature[first + w], cut[first + w] = best_f[w], cuts[best_f[w]][best_b[w]]
                at = np.arange(len(y))
                node = 2 * node + 1 + (x[at, feature[node]] > cut[node])
            leaf = node - inner
            g, h = (np.bincount(leaf, weights=v, minlength=inner + 1) for v in (grad, hess))
            value = self.rate * g / (h + self.l2)
            margin += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        at = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[at, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margin, probability) of the pooled-adjacent-violators fit, to interpolate between."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, label in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([label, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Scorer:
    """Lexicon, trees and calibration; a constant if there was nothing to learn from."""

    def __init__(self, lexicon: dict[str, float], constant: float = 0.0):
        self.lexicon, self.constant, self.trees = lexicon, constant, None

    def fit(self, x: np.ndarray, y: np.ndarray, calibration: np.ndarray) -> None:
        if y[~calibration].min(initial=1) == y[~calibration].max(initial=0) or not calibration.any():
            self.constant = float(y.mean()) if len(y) else 0.0
            return
        self.trees = BoostedTrees().fit(x[~calibration], y[~calibration])
        self.knots = isotonic(self.trees.margins(x[calibration]), y[calibration])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.trees.margins(x), *self.knots), 0.0, 1.0)


def _feature_rows(texts: list[str | None], codes: _Codes) -> np.ndarray:
    return np.stack([features(t or "", codes) for t in texts]) if texts else np.zeros((0, len(FEATURES)))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """rows (text, toxic): words, and word beginnings written with a plus, with their log odds."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)
    starts = [F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substr(w, F.lit(1), F.lit(n)), F.lit("+"))) for n in PREFIXES]
    cues = rows.select("toxic", F.explode(F.array_distinct(F.concat(words, *starts))).alias("cue"))
    counts = cues.groupBy("cue").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n"))
    totals = rows.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n")).first()
    if not totals["t"] or not totals["n"]:
        return {}
    odds = F.log((F.col("t") + 0.5) / (totals["t"] + 1.0)) - F.log((F.col("n") + 0.5) / (totals["n"] + 1.0))
    kept = counts.withColumn("odds", odds).filter((F.col("t") >= MIN_TOXIC_ROWS) & (F.col("odds") >= MIN_LOG_ODDS))
    return {r["cue"]: float(r["odds"]) for r in kept.orderBy(F.desc("t"), "cue").limit(MAX_LEXICON).collect()}


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_rows: int = 8000, max_lexicon_rows: int = 4000,
) -> Scorer:
    """A scorer fitted on bounded samples: at most max_rows rows of each label, by the hash of their id; of the
    first max_lexicon_rows of these, those outside the calibration fold, the lexicon, of at most MAX_LEXICON
    cues, the most frequent in toxic texts; trees on three folds, the isotonic map on the fourth."""
    known = labels.filter(F.col(label_col).isNotNull() & learned_rows(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    pick = lambda n: known.filter("toxic = 1").orderBy(F.xxhash64("id"), "id").limit(n).union(known.filter("toxic = 0").orderBy(F.xxhash64("id"), "id").limit(n))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fold = lambda i: F.pmod(F.xxhash64(i, F.lit(1)), F.lit(4)).cast("int")
    # Rows of the calibration fold teach the lexicon nothing, or their features would look too good.
    lexicon = learn_lexicon(texts.join(F.broadcast(pick(max_lexicon_rows).filter(fold(F.col("id")) != 0)), "id").select("text", "toxic"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(lexicon)
        for batch in batches:
            made = _feature_rows(batch.column(0).to_pylist(), codes)
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "toxic", "fold"])

    chosen = texts.join(F.broadcast(pick(max_rows)), "id").select("text", "toxic", fold(F.col("id")).alias("fold"))
    found = chosen.mapInArrow(rows, "x array<double>, toxic int, fold int").limit(4 * max_rows).collect()
    scorer = Scorer(lexicon)
    if found:
        x, y, fold = (np.array([r[k] for r in found]) for k in ("x", "toxic", "fold"))
        order = np.lexsort((*x.T, fold, y))  # the rows' order mustn't matter
        scorer.fit(x[order], y[order].astype(float), fold[order] == 0)
    return scorer


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted (1 if score >= threshold) of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = dict(docs.dtypes)[id_col]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(model.value.lexicon)
        for batch in rows:
            s = model.value.scores(_feature_rows(batch.column(1).to_pylist(), codes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
