"""Collocations, html extraction and fill-in-the-middle against brute force and hand-made pages, on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultloom.llm import collocations, fill_in_middle, html_text

from .common import empty_docs, odd_docs, odd_rows

LOWER = {k: k + 32 for k in range(65, 91)}


# op13

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SENTINELS = ("<P>", "<S>", "<M>")


def brute_fim(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD_TEXTS = ["", " ", "a", " a", "a ", "a\n\nb", "\x0b\x0c", "<P>", "x<P", "<P >", "<<P>", "<P<S>", "P>", "é<M>ü", "日本 語\t𝄞x ", "<X>", "a<", "<", "  x", "\x1c a", "<S", "<M>"]


@pytest.mark.parametrize("rate", [50, 100])
def test_fill_in_middle(spark, rate):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(1000 + 50 * k + j, t + " tail" * j) for k, t in enumerate(ODD_TEXTS) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("output", F.lit("clash"))
    made = fill_in_middle.fill_in_middle(docs, rate=rate)
    got = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(brute_fim(*r, rate=rate) for r in rows)
    whole = Counter((i, t or "") for i, t in rows)
    assert Counter((r.doc_id, r.back) for r in got) == whole
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(empty_docs(spark)).count() == 0


def test_scan_in_slices_of_any_length(monkeypatch):
    texts = [t.encode() for t in ODD_TEXTS * 3] + [("wö<P> " * 99).encode()]
    whole = fill_in_middle.Cuts(texts)
    for size in (2, 3, 7):
        monkeypatch.setattr(fill_in_middle, "SLICE", size)
        cuts = fill_in_middle.Cuts(texts)
        assert np.array_equal(cuts.emitted, whole.emitted) and np.array_equal(cuts.units, whole.units)
    assert whole.units.tolist() == [len(UNIT.findall(t.decode())) for t in texts]
    assert whole.marked.tolist() == [any(s in t.decode() for s in SENTINELS) for t in texts]


# op11


def brute_collocations(rows, max_words=3, min_count=10, cover=50, top=2000):
    counts, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    counts[lang or "und", " ".join(w[i : i + k])] += 1
    out = []
    frequent = {key: a for key, a in counts.items() if a >= min_count and " " in key[1]}
    for lang in total:
        found = []
        for (g, phrase), a in frequent.items():
            if g != lang:
                continue
            w = phrase.split(" ")
            if any(100 * b >= cover * a and len(p.split(" ")) > len(w) and f" {phrase} " in f" {p} " for (g2, p), b in frequent.items() if g2 == lang):
                continue
            cuts = [(1_000_000 * a * a // (counts[lang, " ".join(w[:k])] * counts[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.append((-score, -a, phrase.encode(), phrase, a, counts[lang, " ".join(w[:k])], counts[lang, " ".join(w[k:])], score))
        out += [(lang, rank, p, a, left, right, total[lang], score) for rank, (*_, p, a, left, right, score) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_rows():
    rng = np.random.default_rng(4)
    words = ["new", "york", "city", "Öl", "a", "the", "of", "z.", "in,", "x\ty", "q\nr"]
    weights = np.array([8, 8, 6, 3, 9, 9, 9, 2, 2, 2, 1]) / 59
    rows = [(k, " ".join(rng.choice(words, rng.integers(0, 60), p=weights)), ("en", "de", None)[k % 3]) for k in range(120)]
    rows += [(k, "new york city of the new york", "en") for k in range(200, 220)] + [(300, None, "en"), (301, "", None), (302, " \t. ,", "fr"), (None, "x y " * 40, "fr"), (None, "x y " * 40, "fr")]
    return rows


@pytest.mark.parametrize("max_words, shard, bits", [(3, 3_000_000, 1 << 20), (3, 100, 64), (4, 300, 1 << 12), (2, 50, 64)])
def test_collocations(spark, monkeypatch, max_words, shard, bits):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("k", F.lit("clash")).withColumn("f", F.lit("clash")).repartition(3)
    got = collocations.collocations(docs, max_words=max_words, filter_bits=bits)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, max_words)
    few = collocations.collocations(docs, max_words=max_words, top=3, filter_bits=bits)
    assert sorted(map(tuple, few.collect())) == brute_collocations(rows, max_words, top=3)


def test_collocations_of_odd_rows(spark):
    rows = odd_rows()
    got = collocations.collocations(odd_docs(spark), min_count=30)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, min_count=30)
    assert collocations.collocations(empty_docs(spark)).count() == 0


def test_collocation_counts_past_64_bits(spark):
    """a * a * 1000000 passes 64 bits from a = 5 million on."""
    a, left, right = 9_000_000_019, 9_000_000_021, 123_456_789_012
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(left).alias("l"), F.lit(right).alias("r"))
    score = row.select(F.expr("(cast(a as decimal(14,0)) * cast(a as decimal(14,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(14,0)) * cast(r as decimal(14,0)))")).first()[0]
    assert score == 1_000_000 * a * a // (left * right)


def test_automaton_links():
    level = collocations.Automaton(np.array([1, 2, 1, 2, 3, 0, 2, 3], np.int32), 3)
    assert level.count.tolist() == [0, 2, 3, 2]
    two = level.deeper()
    pairs = {(a, b): n for a, b, n in zip(two.stem.tolist(), two.link.tolist(), two.count.tolist(), strict=True)}
    assert pairs == {(1, 2): 2, (2, 1): 1, (2, 3): 2}
    three = two.deeper()
    assert sum(three.count) == 3 and three.last.tolist() == [2 if two.link[k] == 2 else 1 if two.link[k] == 1 else 3 for k in three.link]


# op12

CHROME = """<header class="masthead"><a href="/">Home of news</a></header><nav><ul><li><a href="/a">One</a></li><li>Two</li></ul></nav>
<div class="cookie-notice">We use cookies on this site.</div><div id="sidebar"><p>Most read today</p></div>"""
END = """<section id="comments"><article class="comment"><p>First!</p></article></section><form><label>Mail</label><input name=m></form>
<footer>&copy; Example</footer><script>if (a < b) document.write("<article><p>no</p></article>")</script></body></html>"""


def page(body):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p > a {{}}</style></head><body class="with-sidebar">{CHROME}{body}{END}'


@pytest.mark.parametrize(
    "body, text",
    [
        ("<article><h1>A &amp; B</h1><p>One  <b>two</b>\n three.<p>Four&nbsp;five<br>six</article>", "A & B\nOne two three.\nFour five six"),
        ('<article><header class="entry-header"><h1 class="page-header">T</h1></header><div class="ad">Buy</div><p>x<sup>2</sup></p><aside>Aside</aside><ul><li>a<li>b</ul><footer>By me</footer></article>', "T\nx2\na\nb"),
        ('<main><div class="breadcrumbs">You are here</div><h1>M</h1><p>Body</p><section class="related-posts"><h2>More</h2><article class="related"><p>Other</p></article></section></main>', "M\nBody"),
        ('<div id="main-content" class="content"><h2>C</h2><p>P<!-- <p>no</p> --></p><div style="display: none">hidden</div><p hidden>too</p></div>', "C\nP"),
        ("<div><h1>Plain</h1><p>No part is marked here.</p><p><a href=1>All</a> <a href=2>links</a></p></div>", "Plain\nNo part is marked here."),
        ('<article class="post has-sidebar category-advertising"><p title="a > b">Text</p><table><tr><td>1<td>2</table><noscript>no</noscript><blockquote>Q</blockquote></article>', "Text\n1\n2\nQ"),
        ('<article><p>1 &lt; 2 &#x41;&#66;&eacute;</p><iframe src=x>no</iframe><select><option>o</select><button>b</button><p>cut <i>off', "1 < 2 ABé\ncut off"),
        ("<article></article>", ""),
    ],
)
def test_main_blocks(body, text):
    html = page(body) if "cut <i>" not in body else page(body).split(END)[0]
    assert "\n".join(html_text.main_blocks(html)[1]) == text


def brute_covered(pages, share):
    """Tokens of runs on enough pages, by comparing all windows as they are."""
    run = html_text.RUN
    on = defaultdict(set)
    for k, (_, blocks) in enumerate(pages):
        for block in blocks:
            w = block.split(" ")
            for i in range(max(1, len(w) - run + 1)):
                on[tuple(w[i : i + run])].add(k)
    least = max(2, int(np.ceil(share * len(pages))))
    out = []
    for marked, blocks in pages:
        left, gone, size = [], 0, 0
        for block in blocks:
            w = block.split(" ")
            hit = [False] * len(w)
            for i in range(max(1, len(w) - run + 1)):
                if len(on[tuple(w[i : i + run])]) >= (max(html_text.MARKED_PAGES, least) if marked else least):
                    hit[i : i + run] = [True] * len(w[i : i + run])
            if marked and not all(hit):
                hit = [False] * len(w)
            gone, size = gone + sum(hit), size + len(w)
            left.append(" ".join(x for x, h in zip(w, hit, strict=True) if not h))
        out.append(blocks if 2 * gone > size else [b for b in left if b])
    return out


def host_pages(seed, marked):
    rng = np.random.default_rng(seed)
    new = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 40, n))
    menu, note = "Home News Sport", "You are reading the first edition of our small daily paper"
    pages = []
    for k in range(12):
        blocks = [menu, new(30), note + " " + new(3), new(25)]
        if k % 4 == 0:
            blocks = blocks[1:] + [new(12)]
        pages.append((marked, blocks))
    return pages + [pages[1], (marked, []), (marked, [note]), (marked, [new(9)] * 3)]


@pytest.mark.parametrize("marked", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_template_of_a_host(marked, seed):
    pages = host_pages(seed, marked)
    for share in (0.2, 0.5, 0.9):
        assert html_text.uncovered(pages, share) == brute_covered(pages, share)
    kept = html_text.uncovered(pages, 0.5)
    assert all("Home News Sport" not in b for b in kept[1])
    assert not marked or len(kept[1]) == 3
    assert html_text.uncovered([], 0.5) == [] and html_text.uncovered([(False, ["a b"])], 0.5) == [["a b"]]


def test_extraction(spark):
    def html(k, note=True):
        return "<html><body>" + ("<div>Welcome to the paper that all of us read each day</div>" if note else "") + f"<div><h1>Title {k}</h1><p>{' '.join(f'u{k}x{j}' for j in range(30))}</p></div></body></html>"

    rows = [(k, f"http://A.example.com/{k}", html(k)) for k in range(9)]
    rows += [(20, "http://b.example.com/", html(20)), (21, None, html(21)), (22, "no scheme", html(22)), (23, "http://a.example.com/x", None), (24, "http://a.example.com/y", "")]
    rows += [(None, "http://c.example.com/", page("<article><p>same</p></article>"))] * 3 + [(30, "http://d.com/", "<p>" + "long text " * 40_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "deal", "text", "bytes", "batches", "blocks"):
        pages = pages.withColumn(name, F.lit("clash"))
    got = html_text.extract(pages)
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    found = Counter((r.page_id, r.url, r.text) for r in got.collect())
    clean = lambda k, note: ("Welcome to the paper that all of us read each day\n" if note else "") + f"Title {k}\n{' '.join(f'u{k}x{j}' for j in range(30))}"
    expected = Counter((i, u, clean(i, False)) for i, u, _ in rows[:9])
    expected += Counter((i, u, clean(i, True)) for i, u, _ in rows[9:12])  # a host of one page, or none, has no template
    expected += Counter([(23, "http://a.example.com/x", ""), (24, "http://a.example.com/y", "")])
    expected += Counter({(None, "http://c.example.com/", "same"): 3})
    expected[30, "http://d.com/", ("long text " * 40_000).strip()] += 1
    assert found == expected
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert html_text.extract(pages.filter("false")).count() == 0


def test_large_hosts_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(html_text, "BATCH_BYTES", 3000)
    note = "A note that stands on each and every page of this host"
    rows = [(k, "http://a.com/", f"<div><p>{note}</p><p>{' '.join(f'v{k}y{j}' for j in range(40))}</p></div>") for k in range(60)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 60 and all(r.text == " ".join(f"v{r.page_id}y{j}" for j in range(40)) for r in got)


# op10: hosts that stand out


def test_hosts_that_stand_out_fall(spark):
    """Twenty hosts alike, one with many bad documents, and small ones with few: the SQL twin agrees, and only the bad one falls."""
    import duckdb

    from faultloom.llm import quality_rules

    rng = np.random.default_rng(0)
    good = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10_000, 80))
    bad = lambda: "short text"
    rows = [(f"h{k}", bad() if i % 6 == 0 else good()) for k in range(20) for i in range(60)]
    rows += [("worse", bad() if i % 5 < 3 else good()) for i in range(100)] + [("tiny", bad()), ("tiny", bad()), ("tiny", good())] + [(None, good())] * 3
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = sorted(map(tuple, quality_rules.quality_rules(docs).collect()))
    kept = {rows[r[0]][0] for r in got if r[-1]}
    assert "worse" not in kept and kept == {f"h{k}" for k in range(20)} | {"tiny", None}
    assert sum(r[-1] != (not r[-2]) for r in got) == 40  # good documents of the bad host
    documents = docs.toPandas()  # noqa: F841 - read by the query
    assert sorted(duckdb.sql(quality_rules.ORACLE_SQL).fetchall()) == got


def test_large_hosts_are_judged_whole(spark, monkeypatch):
    """Hosts over many batches give what one suffix array over the whole host gives, also for texts near half of the pages."""
    from faultloom.llm import html_text

    rng = np.random.default_rng(12)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4000, n))
    blocks = [word(n) for n in (12, 3, 1, 30)]
    rows = []
    for k in range(61):
        parts = [word(40), word(25)]
        parts += [b for b, odds in zip(blocks, (1, 0.51, 0.49, 0.5)) if rng.random() < odds]
        rng.shuffle(parts)
        body = "".join(f"<p>{p}</p>" for p in parts)
        rows.append((k, "http://big.example/" + str(k), f"<article>{body}</article>" if k % 7 == 0 else f"<body>{body}</body>"))
    rows += [(100 + k, "http://few.example/" + str(k), f"<p>{word(400)}</p><p>{blocks[0]}</p>") for k in range(4)]
    rows += [(200, "http://one.example/", f"<p>{word(900)}</p>"), (201, None, f"<p>{blocks[3]}</p>"), (202, "http://small.example/", f"<p>{blocks[3]}</p>"), (203, "http://small.example/2", f"<p>{blocks[3]}</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    counted = []
    monkeypatch.setattr(html_text, "written", lambda df, name, made=html_text.written: (counted.append(name), made(df, name))[1])
    frequent = html_text.frequent
    for size, named in ((1200, frequent), (5000, frequent), (5000, lambda pages, share: frequent(pages, 2 * share))):  # the last leaves more to count
        monkeypatch.setattr(html_text, "BATCH_BYTES", size)
        monkeypatch.setattr(html_text, "frequent", named)
        assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == whole
    assert "host-counts" in counted
    assert any(blocks[3] in text or blocks[1] in text for text in whole.values()) and not any(blocks[0] in whole[k] for k in range(1, 7))
