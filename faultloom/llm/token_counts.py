"""Token counts by finite-state tokenizer compilation.

A byte-level BPE tokenizer is compiled into two deterministic transducers:

1. ``Splitter`` reads classes of code points and marks where pieces (pre-tokens) begin. It has a
   handful of states, so the text of a batch is cut into equal chunks, each chunk's state map (exit
   state for every entry state) is built for all chunks at once, and the maps are composed by a
   parallel prefix scan. That gives every chunk its entry state; a second pass emits the marks.
2. ``Counter`` reads the bytes of one piece. Its states are built when first met (subset
   construction over the vocabulary's trie): a state is the set of tokens still being read, each with
   the token before it and the number of tokens emitted so far relative to the newest. A transition
   carries the change in the number of tokens. All pieces of a batch run through it side by side.

Why that is exact: a sequence of tokens is what BPE produces if and only if each pair of neighbours
is what BPE produces of the pair's own bytes, and for each prefix exactly one last token fits.

Text between special strings is counted apart; each special string is one token, as in the library.
Whole texts are read. Memory is bounded by the batch (``BATCH_CHARS`` code points) and by
``MAX_STATES`` states, after which the table starts anew (results don't change).

Defined results: a null text counts as empty: 0 bytes, 0 tokens. Equal rows get equal counts; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

CHUNK = 256
BATCH_CHARS = 1 << 20
MAX_STATES = 200_000
FEW = 32  # tokens below a trie node that are looked into one by one

# Classes of code points, as the splitter reads them.
(END, SPACE, GAP, LETTER, NUMBER, OTHER, QUOTE, S, T, R, E, V, M, L, D) = range(15)
N_CLASSES = 15
_LETTERS = (LETTER, S, T, R, E, V, M, L, D)
_NAMED = {"'": QUOTE, "s": S, "t": T, "r": R, "e": E, "v": V, "m": M, "l": L, "d": D, " ": SPACE}

# States of the splitter: what the piece read last is, and how it began.
(START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, SHORT_DONE, ONE_SPACE, ONE_GAP, MORE_SPACE, MORE_GAP) = range(13)
N_STATES = 13
BEGINS_HERE, BEGINS_BEFORE = 1, 2  # a piece begins at this code point; at the one before it


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point. Those too new for this Python's Unicode tables, but letters, numbers
    or spaces in newer ones, are as the tokenizer library's own tables have them."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (GAP, r"\p{White_Space}")):
        found = regex.findall(pattern, points)
        new = [c for c in found if unicodedata.category(c) == "Cn"]
        known = _joins("a" if kind == LETTER else "1", new) if kind != GAP else []
        table[[ord(c) for c in found if unicodedata.category(c) != "Cn"] + [ord(c) for c in known]] = kind
    for c, kind in _NAMED.items():
        table[ord(c)] = kind
    return table


def _joins(front: str, points: list[str]) -> list[str]:
    """The code points that the library keeps in one piece with ``front``."""
    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
    starts = {begin for _, (begin, _) in splitter.pre_tokenize_str("".join(f"{front}{c} " for c in points))}
    return [c for k, c in enumerate(points) if 3 * k + 1 not in starts]


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state and marks of the splitter for pieces 's 't 're 've 'm 'll 'd, letters, numbers and
    others with one space before them, and runs of space without the last one before other text."""
    if kind == END:
        return START, BEGINS_HERE
    if kind in (SPACE, GAP):
        if state in (ONE_SPACE, ONE_GAP, MORE_SPACE, MORE_GAP):
            return (MORE_SPACE if kind == SPACE else MORE_GAP), 0
        return (ONE_SPACE if kind == SPACE else ONE_GAP), BEGINS_HERE
    run = IN_LETTERS if kind in _LETTERS else IN_NUMBERS if kind == NUMBER else IN_OTHERS
    fresh = AFTER_QUOTE if kind == QUOTE else run  # a piece that begins with this code point
    if state == ONE_SPACE:
        return run, 0
    if state == MORE_SPACE:
        return run, BEGINS_BEFORE
    if state == MORE_GAP:
        return fresh, BEGINS_BEFORE | BEGINS_HERE
    if state == AFTER_QUOTE:
        if kind in (S, T, M, D):
            return SHORT_DONE, 0
        if kind in (R, V, L):
            return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[kind], 0
        return (IN_OTHERS, 0) if run == IN_OTHERS else (run, BEGINS_HERE)
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if kind == (L if state == QUOTE_L else E):
            return SHORT_DONE, 0
        if run == IN_LETTERS:
            return run, BEGINS_BEFORE
        return fresh, BEGINS_BEFORE | BEGINS_HERE
    if state == run and state in (IN_LETTERS, IN_NUMBERS, IN_OTHERS):
        return run, 0
    return fresh, BEGINS_HERE


@lru_cache(1)
def _splitter() -> tuple[np.ndarray, np.ndarray]:
    to, marks = np.zeros((N_CLASSES, N_STATES), np.uint8), np.zeros((N_CLASSES, N_STATES), np.uint8)
    for kind in range(N_CLASSES):
        for state in range(N_STATES):
            to[kind, state], marks[kind, state] = _step(state, kind)
    return to, marks


def entry_states(kinds: np.ndarray) -> np.ndarray:
    """kinds: (steps, chunks) classes. The state in which each chunk is entered, START for the first.

    The maps of all chunks are built side by side, then composed by a prefix scan that doubles its
    reach: after round k, maps[c] leads through the 2**k chunks that end with c.
    """
    to, _ = _splitter()
    flat = to.ravel()
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (kinds.shape[1], 1))
    for row in kinds:
        maps = flat[(row.astype(np.int32) * N_STATES)[:, None] + maps]
    reach = 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.int64), axis=1)
        reach *= 2
    return np.concatenate(([START], maps[:-1, START])).astype(np.uint8)


def piece_starts(points: np.ndarray, segment_ends: np.ndarray) -> np.ndarray:
    """For the code points of segments laid end to end: True where a piece begins."""
    kinds = _classes()[points]
    # An END class stands between segments; it is a step of its own.
    at = np.arange(len(points)) + np.searchsorted(segment_ends, np.arange(len(points)), side="right")
    steps = len(points) + len(segment_ends)
    chunks = -(-steps // CHUNK)
    laid = np.full(chunks * CHUNK, END, np.uint8)
    laid[at] = kinds
    grid = np.ascontiguousarray(laid.reshape(chunks, CHUNK).T)
    to, marks = (t.ravel() for t in _splitter())
    state, said = entry_states(grid), np.empty_like(grid)
    for j, row in enumerate(grid):
        k = row.astype(np.int32) * N_STATES + state
        said[j] = marks[k]
        state = to[k]
    said = said.T.ravel()
    begins = (said & BEGINS_HERE).astype(bool)
    begins[:-1] |= (said[1:] & BEGINS_BEFORE).astype(bool)
    return begins[at]


class Vocabulary:
    """A byte-level BPE vocabulary: the trie of its tokens and which tokens may be neighbours."""

    def __init__(self, merges: Sequence[tuple[bytes, bytes]], singles: Sequence[bytes]):
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.tokens: list[bytes] = []
        self.left_edges: list[list[tuple[bytes, int]]] = []
        self.right_edges: list[list[tuple[bytes, int]]] = []
        halves: dict[bytes, tuple[bytes, bytes]] = {}
        for t in dict.fromkeys([*singles, *(a + b for a, b in merges)]):
            parts, last = self.bpe(t)
            if parts != [t]:
                continue  # never produced
            halves[t] = last
            node = 0
            for b in t:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][b]
            self.token_at[node] = len(self.tokens)
            self.tokens.append(t)
            self.left_edges.append(self._edge(t, halves, 0))
            self.right_edges.append(self._edge(t, halves, 1))
        self.below: list[tuple[int, ...] | None] = [None] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):  # children have higher numbers
            found: list[int] = []
            for child in self.children[node].values():
                more = self.below[child]
                if more is None:
                    break
                found += [*more, *([self.token_at[child]] if self.token_at[child] >= 0 else [])]
            else:
                if len(found) <= FEW:
                    self.below[node] = tuple(found)
        self.allowed: dict[tuple[int, int], bool] = {}
        self.hopeful: dict[tuple[int, int], bool] = {}

    def _edge(self, token: bytes, halves: dict[bytes, tuple[bytes, bytes]], side: int) -> list[tuple[bytes, int]]:
        """What stands at one edge of the token while it is merged, with the rank that ends it."""
        found, ends = [(token, 1 << 60)], 0
        while halves[found[-1][0]]:
            pair = halves[found[-1][0]]
            ends = self.rank[pair]
            found.append((pair[side], ends))
        return found

    def bpe(self, data: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | tuple[()]]:
        """Plain BPE: always the pair of the lowest rank; also the pair merged last."""
        parts, last = [data[k : k + 1] for k in range(len(data))], ()
        while len(parts) > 1:
            ranks = [self.rank.get(pair, 1 << 60) for pair in zip(parts, parts[1:], strict=False)]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == 1 << 60:
                break
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts, last

    def neighbours(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes gives the two tokens: no pair across the border comes
        before both of its parts are merged on their own side (the left one first on equal ranks)."""
        if left < 0:
            return True
        key = (left, right)
        known = self.allowed.get(key)
        if known is None:
            if len(self.allowed) > 1_000_000:
                self.allowed.clear()
            known, rank = True, self.rank
            for x, x_ends in self.right_edges[left]:
                for y, y_ends in self.left_edges[right]:
                    r = rank.get((x, y))
                    if r is not None and r < x_ends and r <= y_ends:
                        known = False
                        break
                if not known:
                    break
            self.allowed[key] = known
        return known

    def can_end(self, node: int, before: int) -> bool:
        """Whether a token below this node may follow; only nodes with few tokens are looked into."""
        few = self.below[node]
        if few is None or before < 0:
            return bool(self.children[node])
        key = (node, before)
        known = self.hopeful.get(key)
        if known is None:
            if len(self.hopeful) > 1_000_000:
                self.hopeful.clear()
            known = self.hopeful[key] = any(self.neighbours(before, t) for t in few)
        return known


class Counter:
    """The transducer over the bytes of a piece; states are built when first met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.column, self.bytes_seen, self.width = np.full(256, -1, np.int64), [], 128
        self._clear()

    def _clear(self) -> None:
        self.states = [((0, -1, 0),)]  # (trie node, token before, tokens so far relative to now)
        self.numbers = {self.states[0]: 0}
        self.to = np.full(1024 * self.width, -1, np.int32)
        self.emits = np.zeros(1024 * self.width, np.int16)

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """Table columns for bytes; only bytes that occur have one."""
        columns = self.column[data]
        if len(columns) and columns.min() < 0:
            for b in np.unique(data[columns < 0]).tolist():
                self.column[b] = len(self.bytes_seen)
                self.bytes_seen.append(b)
            if len(self.bytes_seen) > self.width:
                self.width = 256
                self._clear()
            columns = self.column[data]
        return columns

    def _build(self, state: int, column: int) -> None:
        v, moved, last, count, byte = self.vocabulary, [], None, 0, self.bytes_seen[column]
        for node, before, so_far in self.states[state]:
            child = v.children[node].get(byte)
            if child is None:
                continue
            moved.append((child, before, so_far))
            token = v.token_at[child]
            if last is None and token >= 0 and v.neighbours(before, token):
                last, count = token, so_far + 1
        key = (*((n, b, s - count) for n, b, s in moved if v.can_end(n, b)), (0, last, 0))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            if number * self.width >= len(self.to):
                self.to = np.concatenate([self.to, np.full(len(self.to), -1, np.int32)])
                self.emits = np.concatenate([self.emits, np.zeros(len(self.emits), np.int16)])
        self.to[state * self.width + column], self.emits[state * self.width + column] = number, count

    def count(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[begin : begin + length]."""
        if len(self.states) > MAX_STATES:
            self._clear()
        columns = self._columns(data)
        order = np.argsort(-lengths, kind="stable")
        begins, sizes = begins[order], lengths[order]
        tokens, state = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        longest = int(sizes[0]) if len(sizes) else 0
        alive = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
        for j in range(longest):
            n = int(alive[j])
            k = state[:n] * self.width + columns[begins[:n] + j]
            to = self.to[k]
            if to.min() < 0:
                for missing in np.unique(k[to < 0]).tolist():
                    self._build(*divmod(missing, self.width))
                to = self.to[k]
            tokens[:n] += self.emits[k]
            state[:n] = to
        out = np.empty_like(tokens)
        out[order] = tokens
        return out


class CompiledTokenizer:
    """Counts tokens of texts; made of the tokenizer file's content."""

    def __init__(self, content: str):
        spec = json.loads(content)
        split = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or split["type"] != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
            raise ValueError("not a byte-level BPE tokenizer of the known kind")
        self.special = [t["content"] for t in spec["added_tokens"] if t.get("special")]
        byte_of = _byte_alphabet()
        decode = lambda token: bytes(byte_of[c] for c in token)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.counter = Counter(Vocabulary([(decode(a), decode(b)) for a, b in merges], [bytes([k]) for k in range(256)]))

    def counts(self, texts: Sequence[str]) -> np.ndarray:
        """Number of tokens of each text; about BATCH_CHARS code points are in work at a time."""
        total, segments, owners, size = np.zeros(len(texts), np.int64), [], [], 0
        for k, text in enumerate(texts):
            parts = [text]
            for s in self.special:
                parts = [p for x in parts for p in x.split(s)]
            total[k] += len(parts) - 1
            for part in (c for p in parts for c in _cut(p)):
                segments.append(part)
                owners.append(k)
                size += len(part)
                if size >= BATCH_CHARS:
                    self._add(total, segments, owners)
                    segments, owners, size = [], [], 0
        self._add(total, segments, owners)
        return total

    def _add(self, total: np.ndarray, segments: list[str], owners: list[int]) -> None:
        text = "".join(segments)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return
        ends = np.cumsum([len(s) for s in segments])
        starts = np.flatnonzero(piece_starts(points, ends[:-1]))
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        begins = offset[starts]
        tokens = self.counter.count(data, begins, np.diff(np.append(begins, offset[-1])))
        np.add.at(total, np.asarray(owners)[np.searchsorted(ends, starts, side="right")], tokens)


#: Between a letter and a space with a letter behind it, a piece always begins.
_SAFE_CUT = re.compile(r"[A-Za-z](?= [A-Za-z])")


def _cut(text: str) -> Iterator[str]:
    """The text in parts of little more than BATCH_CHARS, cut where that changes no piece."""
    at = 0
    while len(text) - at > 2 * BATCH_CHARS and (m := _SAFE_CUT.search(text, at + BATCH_CHARS)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, reversed."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


_COMPILED: dict[int, CompiledTokenizer] = {}


def token_counts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text.

    The tokenizer file is read on the driver and broadcast (its size doesn't depend on the data).
    """
    spark: SparkSession = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(content.value)
        if key not in _COMPILED:
            _COMPILED[key] = CompiledTokenizer(content.value)
        compiled = _COMPILED[key]
        for batch in rows:
            counts = compiled.counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = narrow.mapInArrow(batches, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
