"""URL filters: host rules first, then logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled URL table (``LABELLED_URLS`` or any list of
at most ``MAX_TRAINING_URLS`` pairs). Features are the character n-grams (2 to 4 bytes) of host and
path, hashed to 2**15 slots, host and path in halves of their own; each text counts an n-gram once
for each place, scaled by the number of places. The weights (a fixed 256 KB) travel with the task.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is
judged by the model (whose score for no n-grams is that of its intercept); equal urls get equal
verdicts; an empty table gives an empty result; a url of any length is used whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.llm._common import ascii_lower

MAX_TRAINING_URLS = 100_000
SLOT_BITS = 15
NGRAMS = (2, 3, 4)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(1_000_003)

#: (rule, verdict); a rule is a host and a path, which starts with a slash.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

# Site names of the labelled table: each word alone and with four fillers, before or behind it. The words are
# subjects; names of sites of the judged tables are not among the names made of them.
_UNWANTED = (
    "casino", "poker", "slots", "roulette", "jackpot", "lottery", "bets", "betting", "bookmaker", "pills", "pharma", "meds", "viagra",
    "steroids", "slimming", "adult", "xxx", "porn", "escort", "webcam-girls", "spam", "linkfarm", "link-farm", "ads", "adserver", "banner-ads",
    "clicktrack", "popup", "payday", "quick-loan", "free-money", "get-rich", "warez", "keygen", "cracked", "replica", "fake-watch",
    "miracle-cure", "binary-option", "prize-winner", "win-big", "cheap-deal",
)
_WANTED = (
    "library", "museum", "university", "school", "college", "council", "weather", "news", "journal", "science", "physics", "history", "garden",
    "kitchen", "recipes", "travel", "music", "orchestra", "sports", "rowing", "health", "hospital", "law", "open-data", "docs", "wiki", "forum",
    "blog", "research", "archive", "theatre", "farmers", "city", "parish", "photo", "chess", "maths", "poetry", "film", "trains", "harbour", "nature",
)
_FILLERS = {1: ("shop", "deal", "best", "online", "bonus", "hub", "24", "top"), 0: ("the", "our", "my", "local", "online", "daily", "club", "info")}
_SYLLABLES = ("ti", "on", "th", "an", "re", "her", "in", "sha", "lo", "ble", "ka", "mi", "ro", "den", "ver", "sal")


def _site_names() -> list[tuple[str, int]]:
    """(site, label): words with fillers, and as many wanted names of syllables, which any name may be made of."""
    sites = []
    for label, words in ((1, _UNWANTED), (0, _WANTED)):
        fillers = _FILLERS[label]
        for k, word in enumerate(words):
            sites += [(f"{fillers[(k + j) % 8]}-{word}" if j % 2 else f"{word}-{fillers[(k + j) % 8]}", label) for j in range(4)]
            sites.append((word, label))
    n = len(_SYLLABLES)
    return sites + [(_SYLLABLES[k % n] + _SYLLABLES[(k * 7 + 3) % n] + _SYLLABLES[(k * 5 + k // n) % n], 0) for k in range(5 * len(_UNWANTED))]


def labelled_urls(sites: Sequence[tuple[str, int]]) -> list[tuple[str, int]]:
    """Urls of labelled sites under common hosts and paths, which are the same for both labels."""
    fronts, ends = ("", "www.", "m.", "blog."), (".example.org", ".example.net", ".example.com")
    paths = ("/en/12", "/de/345.html", "/fr/67/", "/es/890", "/en/401.html", "/")
    return [
        (f"http://{fronts[(k + j) % 4]}{site}{ends[(k + 2 * j) % 3]}{paths[(k + j) % 6]}", label)
        for k, (site, label) in enumerate(sites)
        for j in range(3)
    ]


SITES = _site_names()
LABELLED_URLS = labelled_urls(SITES)


def word_held_out(site: str, folds: int = 5) -> bool:
    """Whether a site's longest part falls in the held-out fold, so that all names with that part do."""
    return zlib.crc32(max(site.split("-"), key=len).encode()) % folds == 0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null: same host or a subdomain, and a path that starts with the rule's."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def split_url(url: str) -> tuple[str, str]:
    """host_of and path_of for one string on the driver."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    host, path = rest[:end], rest[end:]
    cut = min((k for k in (path.find(c) for c in "?#") if k >= 0), default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:cut]


def slots(texts: Sequence[str], half: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) for every n-gram of every text; slots of half 0 and 1 don't meet."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter((len(b) for b in raw), np.int64, len(raw))
    row = np.repeat(np.arange(len(raw)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))  # bytes from here to the text's end
    rows, found = [], []
    for n in NGRAMS:
        h = np.full(max(0, len(data) - n + 1), np.uint64(n))
        for j in range(n):
            h = h * _BASE + data[j : len(data) - n + 1 + j]
        inside = left[: len(h)] >= n
        h = ((h ^ (h >> np.uint64(29))) * _MIX) >> np.uint64(64 - SLOT_BITS + 1)
        rows.append(row[: len(h)][inside])
        found.append(h[inside].astype(np.int64) + (half << (SLOT_BITS - 1)))
    return np.concatenate(rows), np.concatenate(found)


def _sums(hosts: Sequence[str], paths: Sequence[str], weights: np.ndarray) -> np.ndarray:
    total = np.zeros(len(hosts))
    for half, texts in enumerate((hosts, paths)):
        row, slot = slots(texts, half)
        if len(row):
            count = np.bincount(row, minlength=len(texts))
            total += np.bincount(row, weights=weights[slot], minlength=len(texts)) / np.sqrt(np.maximum(count, 1))
    return total


def train(labelled: Sequence[tuple[str, int]], epochs: int = 200, rate: float = 1.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, intercept) by full-batch gradient descent with AdaGrad steps."""
    if len(labelled) > MAX_TRAINING_URLS:
        raise ValueError(f"more than {MAX_TRAINING_URLS} labelled urls; sample them first")
    hosts, paths = zip(*(split_url(u) for u, _ in labelled), strict=True)
    y = np.array([label for _, label in labelled], float)
    row, slot, scale = [], [], []
    for half, texts in enumerate((hosts, paths)):
        r, s = slots(texts, half)
        row.append(r)
        slot.append(s)
        scale.append(1 / np.sqrt(np.maximum(np.bincount(r, minlength=len(texts)), 1))[r])
    r, s, v = map(np.concatenate, (row, slot, scale))
    w, b = np.zeros(1 << SLOT_BITS), 0.0
    seen, seen_b = np.full(len(w), 1e-6), 1e-6
    for _ in range(epochs):
        z = np.bincount(r, weights=w[s] * v, minlength=len(y)) + b
        error = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = np.bincount(s, weights=error[r] * v, minlength=len(w)) + l2 * w
        gb = error.sum()
        seen += g * g
        seen_b += gb * gb
        w -= rate * 0.1 * g / np.sqrt(seen)
        b -= rate * 0.1 * gb / np.sqrt(seen_b)
    return w, float(b)


def score(hosts: Sequence[str], paths: Sequence[str], model: tuple[np.ndarray, float]) -> np.ndarray:
    """Probability that a url is unwanted."""
    return 1 / (1 + np.exp(-(_sums(hosts, paths, model[0]) + model[1])))


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    labelled: Sequence[tuple[str, int]] = LABELLED_URLS,
    threshold: float = 0.5,
) -> DataFrame:
    """page_id, host, path, rule (or null), score (the model's), verdict (allow or block)."""
    w, b = train(labelled)
    model = (w.astype(np.float32), b)

    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series(score(list(hosts), list(paths), model))

    score_udf = F.pandas_udf(scored, T.DoubleType())
    verdicts = dict(rules)
    by_rule = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = split.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("score", score_udf("host", "path"))
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce(by_rule, by_model))
