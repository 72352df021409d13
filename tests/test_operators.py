"""Operators that SQL can't express, against plain Python."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultloom.operators import anomaly, causal, expand, graph, quads, reason, rules, tokens, walks


def test_early_stop(spark):
    rng = np.random.default_rng(0)
    rows = [(q, p, int(c), float(rng.integers(1, 5)) / 10) for q in range(5) for p in range(6) for c in rng.choice(8, 3, replace=False)]
    got = reason.early_stop(spark.createDataFrame(rows, "query_id long, priority int, cand int, score double"), 3).collect()
    for q in range(5):
        found = {}
        for p in range(6):
            for _, _, c, s in sorted(r for r in rows if r[:2] == (q, p)):
                found[c] = sorted([*found.get(c, []), s], reverse=True)
            top = sorted(found.items(), key=lambda x: (x[1], -x[0]), reverse=True)[:3]
            if len({tuple(s) for _, s in top}) >= 3:
                break
        mine = {r.cand: r.n_rules for r in got if r.query_id == q}
        assert mine == {c: len(s) for c, s in found.items()}
        assert all(math.isclose(r.score, 1 - math.prod(1 - s for s in found[r.cand])) for r in got if r.query_id == q)


def test_packing(spark):
    rows = [("a", k, " ".join(["w"] * n)) for k, n in enumerate([3, 4, 9, 1, 1, 20, 2])] + [("b", 0, None)]
    got = tokens.packed(spark.createDataFrame(rows, "key string, seq int, text string").fillna("", ["text"]), 8).orderBy("key", "pack").collect()
    assert [len(r.text.split()) for r in got] == [7, 9, 2, 20, 2, 0]
    kept = tokens.trimmed(spark.createDataFrame(rows, "key string, seq int, text string"), 8).collect()
    assert sorted((r.key, r.seq) for r in kept) == [("a", 0), ("a", 1), ("b", 0)]
    assert tokens.limit_for("gpt-3.5-turbo-16k") == 16_384
    with pytest.raises(ValueError):
        tokens.limit_for("x")


def test_pc_finds_a_collider():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((2, 2000))
    c = a + b + 0.3 * rng.standard_normal(2000)
    d = c + 0.3 * rng.standard_normal(2000)
    edges = causal.pc(["a", "b", "c", "d"], np.corrcoef([a, b, c, d]), 2000, 0.01)
    assert sorted(edges) == [("a", "c", "directed"), ("b", "c", "directed"), ("c", "d", "directed")]


def test_causal_edges_from_frames(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal(400)
    series = {"a": a, "b": a + 0.2 * rng.standard_normal(400), "flat": np.ones(400), "free": rng.standard_normal(400)}
    rows = [(t, k, float(v)) for k, vs in series.items() for t, v in enumerate(vs)]
    got = causal.causal_edges(spark.createDataFrame(rows, "t long, series string, value double"), 0.01).collect()
    assert {frozenset((r.a, r.b)) for r in got} == {frozenset("ab")}


def test_causal_first(spark):
    edges = spark.createDataFrame([("c", "e", 5, True), ("m", "e", 6, False), ("root", "m", 4, True), ("late", "e", 50, True)], "s string, o string, t long, causal boolean")
    seeds, causes = spark.createDataFrame([("e", 10)], "id string, t long"), spark.createDataFrame([("c",), ("m",), ("root",), ("late",)], "id string")
    got = {r.cause: (r.hop, round(r.confidence, 4)) for r in walks.causes_back_in_time(edges, seeds, causes, causal_first=True).collect()}
    assert got == {"c": (1, 0.5), "m": (1, round(0.5 * 0.5 * 0.7, 4)), "root": (2, round(0.7 / 3, 4))}


def test_cyclic_walks_and_rules(spark):
    q = quads.with_inverse(spark.createDataFrame([(1, 0, 2, 9), (2, 1, 3, 5), (3, 2, 1, 4), (3, 2, 1, 7)], "s int, r int, o int, t int"), 3)
    w = walks.cyclic_walks(q, 3, 2, 100).filter("relations[0] = 0 and entities[0] = 1").collect()
    assert sorted((r.entities, r.relations, r.times) for r in w) == [([1, 2, 3, 1], [0, 1, 2], [9, 5, 4])]
    made = walks.cyclic_walks(q, 3, 2, 100).filter("relations[0] = 0 and entities[0] = 1").select(rules.rule_from_walk(F.col("entities"), F.col("relations"), 3).alias("r")).first().r
    assert (made.head_rel, made.body_rels, made.var_constraints) == (0, [5, 4], [])


def test_relaxed_and_sampled_support(spark):
    q = spark.createDataFrame([(1, 0, 2, 5), (2, 1, 3, 3), (2, 1, 4, 9), (1, 2, 4, 10), (1, 2, 3, 1)], "s int, r int, o int, t int")
    assert rules.chain([q.filter("r = 0"), q.filter("r = 1")], relaxed=True).count() == 2
    assert tuple(rules.rule_support(q, 2, [0, 1]).select("body_supp", "rule_supp", "conf").first()) == (1, 1, 1.0)
    assert tuple(rules.sampled_support(q, 2, [0, 1]).first()) == (1, 1)
    assert tuple(rules.rule_support(q, 2, [1, 0]).select("body_supp", "rule_supp", "conf").first()) == (0, 0, 0.0)


def test_dictionary_rejects_unknown_names(spark):
    names = spark.createDataFrame([("a", 0)], "name string, id int")
    with pytest.raises(Exception, match="not in the dictionary"):
        quads.encode(spark.createDataFrame([("b",)], "x string"), names, "x", "y").collect()


def test_samples_repeat(spark):
    q = spark.range(500).select((F.col("id") % 7).cast("int").alias("s"), (F.col("id") % 3).cast("int").alias("r"), F.col("id").cast("int").alias("o"), F.col("id").cast("int").alias("t"))
    for draw in (lambda x: walks.sample_start(x, 5), walks.sample_by_time, lambda x: walks.sample_anchors(x, 9)):
        assert sorted(draw(q).collect()) == sorted(draw(q.repartition(5)).collect())
    assert walks.sample_start(q, 5).count() == 15
    late = walks.sample_by_time(q).agg(F.avg("t")).first()[0]
    assert 300 < late < 370  # the mean of a linear density


def test_empty_tables(spark):
    m = spark.createDataFrame([], "t long, service string, metric string, value double")
    assert anomaly.baseline_anomalies(m, 0, 1, 2).count() == 0 and anomaly.top_anomaly(anomaly.scored(m, 0, 1, 2)).count() == 0
    events = graph.metric_events(m.withColumn("zscore", F.lit(0.0)))
    calls = spark.createDataFrame([], "minute_ts long, src string, dst string")
    assert graph.tkg_nodes(events, calls).count() == 0 and graph.tkg_edges(events, calls).count() == 0
    assert graph.density(graph.tkg_nodes(events, calls), graph.tkg_edges(events, calls)).first().density == 0.0
    nan = spark.createDataFrame([(t, "a", "m", v) for t, v in enumerate([1.0] * 6 + [float("nan"), None, float("inf"), 9.0])], m.schema)
    assert [r.zscore for r in anomaly.scored(nan, 0, 6, 20).collect()] == [8.0]


def test_state_after_batches():
    from faultloom.streaming.events import _states

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state = State()
    frame = lambda rows: pd.DataFrame(rows, columns=["event_id", "t", "service", "type", "value"])
    first = list(_states(("s",), [frame([(1, 10, "s", "error", 1.0)] * 4)], state))[0]
    second = list(_states(("s",), [frame([(2, 5, "s", "error", 2.0), (3, 20, "s", "view", 3.0), (4, 21, "s", "error", 1.0)])], state))[0]
    assert (first.error_count[0], bool(first.anomalous[0])) == (4, False)
    assert (second.error_count[0], second.last_error[0], bool(second.anomalous[0])) == (6, 21, True)


def test_windows_near_facts_and_latest_objects(spark):
    """Against every pair of a query and a fact; repeated queries, subjects as objects, times without facts."""
    rng = np.random.default_rng(5)
    facts = sorted({tuple(int(x) for x in r) for r in rng.integers(0, [6, 3, 6, 60], (200, 4))})
    asked = [(k, *(int(x) for x in r)) for k, r in enumerate(rng.integers(0, [8, 3, 90], (40, 3)))] + [(40, 1, 1, 30), (41, 1, 1, 30)]
    q = spark.createDataFrame(asked, "query_id long, s int, r int, t int")
    e = spark.createDataFrame(facts, "s int, r int, o int, t int")
    pairs = [(k, t, f) for k, _, _, t in asked for f in facts if t - 7 <= f[3] < t]
    flat = lambda rows: sorted((k, t, *f) for k, t, f in rows)
    assert sorted(map(tuple, quads.query_windows(q, e, 7).collect())) == flat(pairs)
    subject, relation = {k: s for k, s, _, _ in asked}, {k: r for k, _, r, _ in asked}
    assert sorted(map(tuple, quads.near_facts(q, e, 7).collect())) == flat([x for x in pairs if subject[x[0]] in (x[2][0], x[2][2])])
    assert sorted(map(tuple, quads.near_facts(q, e, 7, "r").collect())) == flat([x for x in pairs if relation[x[0]] == x[2][1]])
    last = {}
    for k, t, f in pairs:
        last[k, t, f[2]] = max(f[3], last.get((k, t, f[2]), -1))
    assert {(r.query_id, r.q_t, r.cand): r.t for r in expand.latest_objects(q, e, 7).collect()} == last
    empty = q.limit(0)
    assert quads.near_facts(empty, e, 7).isEmpty() and expand.window_recency(empty, e, 7).isEmpty()
