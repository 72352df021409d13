"""The pipeline over the smallest tables, stage by stage."""

import os
import random
import re

import pytest

import corpus_pipeline
from faultloom.llm import queries
from .common import SCHEMA, empty_docs, sentence

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == columns
            docs = made.cache()
            assert 0 < docs.count() <= before
            before = docs.count()
        else:
            assert made.filter("copies < 1 or copies > 3").count() == 0


def test_every_query_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert list(corpus_pipeline.queries()) == ["pipeline"] and len(corpus_pipeline.STAGES) == 5


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def first_of_groups(rows):
    """The smallest id of each component of texts with a similarity of 0.8 or more, by all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((of(a), of(b)))
                root[high] = low
    return {of(i) for i in sets}


def words_of(text):
    return re.findall(r"[0-9a-z]+", text.lower())


def windows(text):
    words = words_of(text)
    return {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9))} if words else set()


def test_dedup_and_decontamination_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(k, sentence(rng, 60)) for k in range(60)]
    for k in range(20):  # copies with a changed tail, more than a small cell holds of the last
        rows.append((100 + k, " ".join(rows[k % 5][1].split()[: 60 - k % 9] + [f"tail{k}"])))
    rows += [(200 + k, rows[7][1] + f" end{k}") for k in range(25)]
    items = [(f"i{k}", " ".join(rows[10 + k][1].split()[5:25])) for k in range(4)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    deduped = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).cache()
    kept = {r.doc_id for r in deduped.collect()}
    assert kept == first_of_groups(rows)
    clean = {r.doc_id for r in corpus_pipeline.decontaminated(spark, deduped, str(tmp_path)).collect()}
    unwanted = set().union(*[windows(t) for _, t in items])
    assert clean == {i for i, t in rows if i in kept and not windows(t) & unwanted}
    assert corpus_pipeline.near_dedup(spark, empty_docs(spark), str(tmp_path)).count() == 0
    assert corpus_pipeline.decontaminated(spark, empty_docs(spark), str(tmp_path)).count() == 0
    assert corpus_pipeline.pseudonymized(spark, empty_docs(spark), str(tmp_path)).count() == 0
    assert corpus_pipeline.mixed(spark, empty_docs(spark), str(tmp_path)).count() == 0
