"""HTML extraction: the main text of pages, from markup and from a suffix array of each host.

A page's html becomes blocks of text. What the markup itself names as menus, headers, footers, sidebars, notices,
adverts, forms or comments goes; if a part is marked as the article (or else as main, or as content), only that
part's blocks stay. What is left can still hold template text that no markup tells apart. For that the token streams of
a host's pages are concatenated, one block after the other, and their suffixes sorted to a depth of ``RUN`` words by
prefix doubling. Suffixes of distinct pages that agree to that depth are next to each other; where enough of
the host's pages agree (``share``), the words are covered. Long repeats are chains of such suffixes, so all of
a repeat of ``RUN`` words or more is covered, wherever it begins and ends; a shorter block is one suffix by itself.

* Pages without a marked part: covered words go, the unique runs of a block stay.
* Blocks of a marked part: a block goes if all of it is covered on at least ``MARKED_PAGES`` pages too, as
  articles of one host may well share passages; single covered words in it stay.
* A page of whose words less than half would stay keeps all: it is a copy of other pages, not template.

The suffix array alone can't find adverts or footers that differ from page to page, and it would take passages
that articles share for template; hence the markup.

Scale: blocks are cut out before rows move, and move by host. A host with more than ``BATCH_BYTES`` of html is dealt into
batches by the hash of page_id, so that no task holds a large host. What is template there is known before: batches name what is on
many of their pages, and what is named is counted over all pages of the host, so the result is that of the whole host. Pages are read as a stream
sorted by batch; one batch is held at a time.

Defined results: a null html counts as empty and has an empty text; a null url, or one without a host, shares its template with
no other page; a null page_id is a page like others; repeated rows are pages of their own, and equal pages keep
their text; cut-off markup ends with the page; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultloom.llm._common import discard, written
from faultloom.llm.url_filter import host_of

RUN = 8
MARKED_PAGES = 5
BATCH_BYTES = 2 << 20
LINKED = 0.7  # share of a block's characters in links from which it is a menu, where no part is marked

# Elements of HTML by what they mean for a text.
_DROPPED = frozenset("nav aside footer form dialog menu button select datalist fieldset head".split())
_OPAQUE = "script|style|noscript|template|textarea|iframe|svg|math|object|canvas|video|audio|title"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter output progress q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
# Words in class, id and role that name what isn't main text, and what is.
_NOT_MAIN = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc header masthead "
    "topbar footer colophon copyright sidebar sidenav aside complementary widget widgets related recommended recommendations share sharing social cookie cookies consent gdpr notice notices notification alert popup "
    "modal overlay newsletter subscribe subscription signup login search searchbox comment comments commentlist respond reply replies disqus contentinfo skip toolbar outbrain taboola".split()
)
_TITLE_NAMES = frozenset("header masthead".split())
_NO_ARTICLE = frozenset("ad ads advert promo sponsored comment comments reply related recommended".split())
_BESIDE = frozenset("with has no without is not category tag type format".split())
_MAIN_NAMES = frozenset("article content entry post story main maincontent articlebody postbody".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_OPAQUE})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)

#: Ranks of parts: the best that a page has is its text.
PLAIN, CONTENT, MAIN, ARTICLE = range(4)


def _judged(name: str, attributes: str, around: int) -> tuple[bool, int]:
    """(whether the element isn't main text, the rank of the part it begins); ``around`` is that of the part it stands in."""
    rank = {"article": ARTICLE, "main": MAIN}.get(name, PLAIN)
    dropped = name in _DROPPED
    if not attributes or dropped or name in ("html", "body"):
        return dropped, rank
    for key, *values in _NAMED.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)):
            return True, rank
        if key == "itemprop":
            rank = max(rank, ARTICLE if value == "articleBody" else PLAIN)
        if key not in ("class", "id", "role"):
            continue
        for token in value.split():
            words = [w.lower() for w in _NAME.findall(token)]
            # "with-sidebar" and the like say what stands beside the text, "category-advertising" what it is about
            if not words or words[0] in _BESIDE:
                continue
            if name in ("article", "main"):
                if words[0] in _NO_ARTICLE:
                    return True, rank
                continue
            against = _NOT_MAIN.intersection(words)
            if against and not (against <= _TITLE_NAMES and (around > PLAIN or name[0] == "h")):  # a title's own header
                return True, rank
            if name not in _INLINE and (not _MAIN_NAMES.isdisjoint(words) or "".join(words) in _MAIN_NAMES) and name[0] != "h":
                rank = max(rank, MAIN if words == ["main"] else CONTENT)
    return False, rank


class _Page:
    """The blocks of one page, in order: (rank of the best part around, share of characters in links, text)."""

    def __init__(self, html: str):
        self.blocks: list[tuple[int, float, str]] = []
        self.open: list[tuple[str, bool, int]] = []  # element, whether dropped, rank
        self.dropped, self.rank, self.links = 0, PLAIN, 0
        self.parts: list[str] = []
        self.linked = 0
        at = 0
        for tag in _TAG.finditer(html):
            self._text(html[at : tag.start()])
            at = tag.end()
            if tag[3]:
                name = tag[3].lower()
                self._close(name) if tag[2] else self._begin(name, tag[4])
        self._text(html[at:])
        self._end_block()

    def _text(self, raw: str) -> None:
        if raw and not self.dropped:
            text = references.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.links:
                self.linked += len(text)

    def _end_block(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            if text := " ".join(raw.split()):
                self.blocks.append((self.rank, self.linked / len(raw), text))
            self.parts, self.linked = [], 0

    def _pop(self) -> None:
        name, dropped, _ = self.open.pop()
        self.dropped -= dropped
        self.links -= name == "a"
        self.rank = self.open[-1][2] if self.open else PLAIN

    def _begin(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        if name not in _INLINE:
            self._end_block()
            if name in _CLOSES_P:
                self._close_to("p", _SCOPES)
        if name in _VOID or attributes.endswith("/") and name in _INLINE:
            return
        if name in ("li", "tr", "td", "th", "dt", "dd", "option"):
            self._close_to(name, _SCOPES | {"ul", "ol", "table", "dl", "select"} - {name})
        if name == "a":
            self._close_to("a", _SCOPES)
        dropped, rank = _judged(name, attributes, self.rank)
        if name == "header" and self.rank < ARTICLE:  # an article's own header holds its title
            dropped = True
        self.open.append((name, dropped, max(rank, self.rank)))
        self.dropped += dropped
        self.links += name == "a"
        self.rank = self.open[-1][2]

    def _close(self, name: str) -> None:
        if name not in _INLINE:
            self._end_block()
        self._close_to(name, _SCOPES if name in _INLINE or name == "p" else frozenset())

    def _close_to(self, name: str, scopes: frozenset[str]) -> None:
        """Ends the innermost open element of a name, and what is open in it; elements of ``scopes`` can't be left that way."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k][0] in scopes:
                return


_SCOPES = frozenset("html body article aside main section div nav footer header form table td th ul ol li blockquote figure details".split())


def main_blocks(html: str) -> tuple[bool, list[str]]:
    """(whether a part is marked as the text, the blocks that the markup leaves)."""
    blocks = _Page(html).blocks
    best = max((rank for rank, _, _ in blocks), default=PLAIN)
    if best > PLAIN:
        return True, [text for rank, _, text in blocks if rank == best]
    return False, [text for _, linked, text in blocks if linked < LINKED]


def _suffix_ranks(words: np.ndarray) -> np.ndarray:
    """The rank of each place's suffix among all, by its first RUN words: prefix doubling."""
    rank, step = words, 1
    while step < RUN:
        follow = np.zeros_like(rank)
        follow[:-step] = rank[step:]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + follow, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return rank


class _Suffixes:
    """The suffixes of pages' blocks: of each that counts its place in the stream, its block and rank, and on how many pages a rank is."""

    def __init__(self, pages: list[tuple[bool, list[str]]]):
        owner, marked, words, sizes = [], [], [], []
        for k, (part, blocks) in enumerate(pages):
            for block in blocks:
                found = block.split(" ")
                words += found
                sizes.append(len(found))
                owner.append(k)
                marked.append(part)
        self.words = words
        # Blocks one after the other, each followed by RUN - 1 fillers, so that no suffix goes on into the next block.
        self.size, self.owner, self.marked = np.array(sizes, np.int64), np.array(owner, np.int64), np.array(marked, bool)
        size = self.size
        self.begin = np.cumsum(size + RUN - 1) - (size + RUN - 1)
        self.length = int((size + RUN - 1).sum())
        place = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)) * (RUN - 1), size)
        stream = np.zeros(self.length, np.int64)
        stream[place] = pd.factorize(np.array(words, object))[0] + 1
        self.rank = _suffix_ranks(stream)
        block = np.repeat(np.arange(len(size)), size)
        offset = place - self.begin[block]
        full = (offset + RUN <= size[block]) | (offset == 0)
        self.at, self.block, self.word = place[full], block[full], np.flatnonzero(full)
        # Suffixes that agree are neighbours once sorted; each page counts once.
        seen = np.unique(self.rank[self.at] * len(pages) + self.owner[self.block])
        self.n_pages = np.bincount(seen // len(pages), minlength=int(self.rank.max()) + 1)


def frequent(pages: list[tuple[bool, list[str]]], share: float) -> tuple[int, list[str], list[int]]:
    """(least, texts, numbers): the suffixes' first RUN words that are on ``least`` of these pages, half of ``share``, and on how many."""
    least = max(1, math.ceil(share * len(pages) / 2))
    if not any(blocks for _, blocks in pages):
        return least, [], []
    s = _Suffixes(pages)
    rank = s.rank[s.at]
    often = np.flatnonzero(s.n_pages[rank] >= least)
    often = often[np.unique(rank[often], return_index=True)[1]]
    ends = s.word[often] + np.minimum(RUN, s.begin[s.block[often]] + s.size[s.block[often]] - s.at[often])
    return least, [" ".join(s.words[i:j]) for i, j in zip(s.word[often].tolist(), ends.tolist(), strict=True)], s.n_pages[rank[often]].tolist()


def numbers_of(pages: list[tuple[bool, list[str]]], texts: list[str]) -> list[int]:
    """On how many of the pages each of the distinct texts, as ``frequent`` gives them, is."""
    if not texts:
        return []
    s = _Suffixes([*pages, (False, texts)])
    return (s.n_pages[s.rank[s.begin[-len(texts) :]]] - 1).tolist()


def uncovered(pages: list[tuple[bool, list[str]]], share: float, known: tuple[int, list[str], list[int]] | None = None) -> list[list[str]]:
    """The blocks of one host's pages less what their suffix array shows as template; with ``known``, of some of its pages less what is
    known to be: how many pages the host has, texts that are on many of them, on how many."""
    n_host, texts, numbers = known or (len(pages), [], [])
    if n_host < 2 or not any(blocks for _, blocks in pages):
        return [blocks for _, blocks in pages]
    s = _Suffixes([*pages, (False, texts)])
    size, owner, marked, begin, rank, at, block, n_pages = s.size, s.owner, s.marked, s.begin, s.rank, s.at, s.block, s.n_pages
    if known:
        n_pages = np.zeros_like(n_pages)
        n_pages[rank[begin[len(begin) - len(texts) :]]] = numbers
    least = max(2, int(np.ceil(share * n_host)))
    needed = np.where(marked[block], max(MARKED_PAGES, least), least)
    hit = n_pages[rank[at]] >= needed
    edges = np.zeros(s.length + 1, np.int64)
    np.add.at(edges, at[hit], 1)
    np.add.at(edges, np.minimum(at[hit] + RUN, begin[block[hit]] + size[block[hit]]), -1)
    covered = np.cumsum(edges)[:-1] > 0
    gone = np.add.reduceat(covered.astype(np.int64), begin)
    taken = np.where(marked, np.where(gone == size, size, 0), gone)
    page_size, page_taken = np.bincount(owner, size, len(pages) + 1), np.bincount(owner, taken, len(pages) + 1)
    out: list[list[str]] = [[] for _ in pages]
    b = 0
    for k, (_, blocks) in enumerate(pages):
        spared = 2 * page_taken[k] > page_size[k]
        for text in blocks:
            if spared or not taken[b]:
                out[k].append(text)
            elif taken[b] < size[b]:
                here = covered[begin[b] : begin[b] + size[b]].tolist()
                out[k].append(" ".join(w for w, c in zip(text.split(" "), here, strict=True) if not c))
            b += 1
    return out


_BLOCKS = "marked boolean, blocks array<string>"


def _cut(pages: DataFrame, id_type: str) -> DataFrame:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [main_blocks(h) for h in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([m for m, _ in made], pa.bool_()), pa.array([b for _, b in made], pa.list_(pa.string()))], ["page_id", "url", "host", "deal", "marked", "blocks"])

    return pages.select("page_id", "url", "host", "deal", "html").mapInArrow(batches, f"page_id {id_type}, url string, host string, deal long, {_BLOCKS}")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.5) -> DataFrame:
    """page_id, url, text (empty if none), n_chars: the main text of every page, blocks joined by line ends."""
    host = host_of(F.col(url_col).cast("string"))
    id_type = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    large = rows.filter("host <> ''").groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes"), F.count(F.lit(1)).alias("n_host")).filter(F.col("bytes") > BATCH_BYTES)
    # Written first: Spark then knows its size, and moves no html for the join if it is small.
    large = written(large.select("host", "n_host", F.ceil(F.col("bytes") / BATCH_BYTES).alias("batches")), "large-hosts")
    mixed = F.xxhash64(F.col("page_id").cast("string"), "url", F.octet_length("html"))
    deal: Column = F.when(F.col("host") == "", mixed).otherwise(F.pmod(mixed, F.coalesce("batches", F.lit(1).cast("long"))))
    dealt = rows.join(large, "host", "left").select("page_id", "url", "host", deal.alias("deal"), "html", F.col("batches").isNotNull().alias("large"))
    moved = _cut(dealt, id_type)
    if not large.isEmpty():
        moved = _with_known(moved, _known(dealt.filter("large"), id_type, large, share), large)
    else:
        moved = _with_known(moved)
    moved = moved.repartition("host", "deal").sortWithinPartitions("host", "deal", F.col("known").isNull())

    def texts(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: list, urls: list, held: list[tuple[bool, list[str]]], known: tuple | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(urls), pa.array(["\n".join(b) for b in uncovered(held, share, known)], pa.string())], ["page_id", "url", "text"])

        for _, ids, urls, held, known in _batches(arrived):
            yield done(ids, urls, held, known)

    return moved.mapInArrow(texts, f"page_id {id_type}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def _batches(arrived: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list, list, list[tuple[bool, list[str]]], tuple | None]]:
    """((host, deal), ids, urls, pages, what is known of the host) of each batch of a host's pages; what is known comes before them."""
    key, ids, urls, held, known = None, [], [], [], None
    for batch in arrived:
        keys = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
        at = 0
        while at < len(keys):
            stop = at + 1
            while stop < len(keys) and keys[stop] == keys[at]:
                stop += 1
            if key != keys[at]:
                if held:
                    yield key, ids, urls, held, known
                key, ids, urls, held, known = keys[at], [], [], [], None
            part = batch.slice(at, stop - at)
            if part.column(6)[0].is_valid:
                told = part.column(6)[0].as_py()
                known, part = (told["n_host"], told["texts"], told["numbers"]), part.slice(1)
            if part.num_rows:
                ids.append(part.column(0))
                urls.append(part.column(1))
                held += zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)
            at = stop
    if held:
        yield key, ids, urls, held, known


_KNOWN = "struct<n_host:long,texts:array<string>,numbers:array<long>>"


def _with_known(moved: DataFrame, known: DataFrame | None = None, large: DataFrame | None = None) -> DataFrame:
    """Pages (page_id, url, host, deal, marked, blocks) with a null ``known``, and for each batch of a large host a row that has it."""
    pages = moved.withColumn("known", F.lit(None).cast(_KNOWN))
    if known is None:
        return pages
    told = F.struct("n_host", F.coalesce("texts", F.array().cast("array<string>")).alias("texts"), F.coalesce("numbers", F.array().cast("array<long>")).alias("numbers")).cast(_KNOWN)
    rows = large.join(known, "host", "left").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)).alias("deal"), told.alias("known"))
    none = [F.lit(None).cast(kind).alias(c) if c not in ("host", "deal", "known") else F.col(c) for c, kind in pages.dtypes]
    return pages.unionByName(rows.select(*none))


def _known(dealt: DataFrame, id_type: str, large: DataFrame, share: float) -> DataFrame:
    """(host, texts, numbers): the texts on ``share`` of a large host's pages.

    Such a text is on that share of some batch's pages. So batches name the texts on half that share of their pages, and one that a batch
    doesn't name is on fewer of its pages than that. What is named by so many batches, or so few, that this decides needs no
    more; for the others all batches are counted.
    """

    def named(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (host, _), _, _, held, _ in _batches(arrived):
            least, texts, numbers = frequent(held, share)
            yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([least - 1], pa.int64()), pa.array([texts], pa.list_(pa.string())), pa.array([numbers], pa.list_(pa.int64()))], ["host", "most", "texts", "numbers"])

    def counted(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (host, _), _, _, held, known in _batches(arrived):
            if known and known[1]:
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(known[1])), pa.array(known[1]), pa.array(numbers_of(held, known[1]), pa.int64())], ["host", "text", "n"])

    spark = dealt.sparkSession
    by_batch = lambda pages: pages.repartition("host", "deal").sortWithinPartitions("host", "deal", F.col("known").isNull())
    found = written(by_batch(_with_known(_cut(dealt, id_type))).mapInArrow(named, "host string, most long, texts array<string>, numbers array<long>"), "host-texts")
    spare = found.groupBy("host").agg(F.sum("most").alias("spare"))  # on how many pages a text may be that no batch names
    texts = found.select("host", "most", F.explode(F.arrays_zip("texts", "numbers")).alias("x")).groupBy("host", F.col("x.texts").alias("text")).agg(F.sum("x.numbers").alias("n"), F.sum("most").alias("most"))
    judged = texts.join(spare, "host").join(large, "host").withColumn("least", F.greatest(F.lit(2).cast("long"), F.ceil(share * F.col("n_host"))))
    judged = judged.withColumn("spare", F.col("spare") - F.col("most")).filter(F.col("n") + F.col("spare") >= F.col("least"))
    judged = judged.withColumn("sure", (F.col("spare") == 0) | (F.col("n") >= F.greatest("least", F.lit(MARKED_PAGES))))
    judged = written(judged.select("host", "text", "n", "least", "sure"), "host-candidates")
    sure, open_ = judged.filter("sure"), judged.filter("not sure")
    made = [judged, found]
    if not open_.isEmpty():
        asked = open_.groupBy("host").agg(F.collect_list("text").alias("texts"))
        pages = _with_known(_cut(dealt.join(asked.select("host"), "host", "left_semi"), id_type), asked.withColumn("numbers", F.lit(None).cast("array<long>")), large.join(asked.select("host"), "host", "left_semi"))
        every = written(by_batch(pages).mapInArrow(counted, "host string, text string, n long").groupBy("host", "text").agg(F.sum("n").alias("n")), "host-counts")
        made.append(every)
        sure = sure.select("host", "text", "n", "least").unionByName(open_.drop("n", "sure").join(every, ["host", "text"]).select("host", "text", "n", "least"))
    listed = sure.filter("n >= least").groupBy("host").agg(F.collect_list(F.struct("text", "n")).alias("x")).select("host", F.col("x.text").alias("texts"), F.col("x.n").alias("numbers"))
    listed = written(listed, "host-templates")
    discard(spark, *made)
    return listed
