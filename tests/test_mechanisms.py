"""Mechanisms of rules, causal search, chains and live graphs against plain Python."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultloom.operators import causal, expand, graph, reason, rules
from faultloom.streaming import events, live

QUADS = "s int, r int, o int, t int"


def some_facts(seed, n=220, entities=9, relations=3, times=40):
    rng = np.random.default_rng(seed)
    return sorted({tuple(map(int, x)) for x in zip(rng.integers(0, entities, n), rng.integers(0, relations, n), rng.integers(0, entities, n), rng.integers(0, times, n), strict=True)})


def walks_of(facts, subject, now, body, constraints, window, relaxed):
    inside = [f for f in facts if now - window <= f[3] < now]
    walks = [([subject], [])]
    for rel in body:
        walks = [(e + [o], t + [ts]) for e, t in walks for s, r, o, ts in inside if s == e[-1] and r == rel and (relaxed or not t or ts >= t[-1])]
    return [(e, t) for e, t in walks if all(e[g[0]] == e[k] for g in constraints for k in g)]


RULES = [
    (1, 0, [1], [], 0.5), (2, 0, [1, 2], [], 0.4), (3, 0, [1, 2], [[0, 2]], 0.9), (4, 0, [1, 2, 0], [], 0.3), (5, 0, [1, 2, 0], [[0, 2]], 0.2), (6, 0, [1, 2, 0], [[1, 3]], 0.25),
    (7, 0, [1, 2, 0], [[0, 2], [1, 3]], 0.6), (8, 0, [1, 1, 1], [[0, 3]], 0.7), (9, 1, [0, 0, 0], [[1, 2, 3]], 0.1), (10, 1, [2], None, 0.8), (11, 2, [7], [], 0.5), (12, 1, [0, 0, 0], [[1, 2]], 0.15),
]


@pytest.mark.parametrize("relaxed, mode", [(False, "origin"), (True, "origin"), (False, "end")])
def test_rules_of_any_length(spark, relaxed, mode):
    facts = some_facts(3)
    asked = [(q, s, r, t) for q, (s, r, t) in enumerate(itertools.product(range(9), (0, 1, 2), (15, 39)))]
    table = spark.createDataFrame(RULES, "rule_id int, head_rel int, body_rels array<int>, var_constraints array<array<int>>, conf double")
    queries, quads = spark.createDataFrame(asked, "query_id long, s int, r int, t int"), spark.createDataFrame(facts, QUADS)
    got = {(x.query_id, x.rule_id, x.cand): x.score for x in reason.apply_rules(queries, table, quads, 12, mode=mode, relaxed=relaxed).collect()}
    whole = Counter((x.query_id, x.rule_id, tuple(x.entities), tuple(x.relations), tuple(x.times)) for x in reason.rule_walks(queries, table, quads, 12, relaxed=relaxed).collect())
    expected, walked = {}, Counter()
    for (q, s, r, t), (i, head, body, cons, conf) in itertools.product(asked, RULES):
        found = walks_of(facts, s, t, body, cons or [], 12, relaxed) if head == r else []
        walked.update((q, i, tuple(e), tuple(body), tuple(ts)) for e, ts in found)
        for cand in {e[-1] for e, _ in found}:
            last = max(ts[0 if mode == "origin" else -1] for e, ts in found if e[-1] == cand)
            expected[q, i, cand] = 0.5 * conf + 0.5 * math.exp(0.1 * (last - t))
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k], rel_tol=1e-9) for k in got)
    assert whole == walked
    assert {i for _, i, _ in got} >= {1, 2, 3, 4, 5, 6, 8, 10}
    assert reason.apply_rules(queries.limit(0), table, quads, 12).count() == 0


def test_a_body_that_is_too_long_is_an_error(spark):
    table = spark.createDataFrame([(1, 0, [1, 1], [], 0.5)], "rule_id int, head_rel int, body_rels array<int>, var_constraints array<array<int>>, conf double")
    queries, quads = spark.createDataFrame([(0, 1, 0, 9)], "query_id long, s int, r int, t int"), spark.createDataFrame([(1, 1, 1, 3)], QUADS)
    with pytest.raises(Exception, match="a body of 2 relations"):
        reason.apply_rules(queries, table, quads, 12, max_length=1).collect()


@pytest.mark.parametrize("length", [1, 2, 3])
def test_chain_rules(spark, length):
    facts, gap = some_facts(5, n=150), 6
    chains = [([s, o], [r], t) for s, r, o, t in facts]
    for _ in range(1, length):
        chains = [(e + [o], b + [r], ts) for e, b, t in chains for s, r, o, ts in facts if s == e[-1] and 0 <= ts - t <= gap]
    head_t = defaultdict(lambda: defaultdict(lambda: -1))
    for s, r, o, t in facts:
        head_t[s, o][r] = max(head_t[s, o][r], t)
    body, hit = Counter(), Counter()
    for e, b, t in chains:
        same = tuple(g for g in (tuple(k for k, x in enumerate(e) if x == v) for v in dict.fromkeys(e)) if len(g) > 1)
        for cons in {(), same}:
            body[tuple(b), cons] += 1
            for h, last in head_t[e[0], e[-1]].items():
                hit[h, tuple(b), cons] += last > t
    expected = {(h, b, cons): (body[b, cons], n, round(n / body[b, cons], 6)) for (h, b, cons), n in hit.items() if n}
    found = rules.chain_rules(spark.createDataFrame(facts, QUADS), length, gap).collect()
    got = {(x.head_rel, tuple(x.body_rels), tuple(map(tuple, x.var_constraints))): (x.body_supp, x.rule_supp, x.conf) for x in found}
    assert got == expected


def all_chains(facts, body, gap, relaxed):
    chains = [(s, o, t) for s, r, o, t in facts if r == body[0]]
    chains = [((s, o), (t,)) for s, o, t in chains]
    for rel in body[1:]:
        chains = [(e + (o,), t + (ts,)) for e, t in chains for s, r, o, ts in facts if s == e[-1] and r == rel and (relaxed or (ts >= t[-1] and (gap is None or ts - t[-1] <= gap)))]
    return chains


@pytest.mark.parametrize("body, gap, relaxed", [([0, 1], None, False), ([0, 1, 2], 8, False), ([1, 2], None, True), ([2], None, False)])
def test_drawn_chains_are_uniform(spark, body, gap, relaxed):
    facts = some_facts(8, n=45, entities=5, times=20)
    every = set(all_chains(facts, body, gap, relaxed))
    samples = 60 * len(every)
    drawn = rules.drawn_chains(spark.createDataFrame(facts, QUADS), body, samples, 5, gap, relaxed)
    n = len(body)
    counts = Counter((tuple(r[f"e{k}"] for k in range(n + 1)), tuple(r[f"t{k}"] for k in range(n))) for r in drawn.collect())
    assert sum(counts.values()) == samples and set(counts) <= every
    chi = sum((counts[c] - 60) ** 2 / 60 for c in every)  # of len(every) - 1 degrees of freedom
    assert abs(chi - (len(every) - 1)) < 5 * math.sqrt(2 * len(every))
    again = rules.drawn_chains(spark.createDataFrame(facts, QUADS).repartition(3), body, samples, 5, gap, relaxed)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, drawn.collect()))


def test_sampled_support_nears_the_exact_one(spark):
    facts = some_facts(2, n=400, entities=12)
    quads = spark.createDataFrame(facts, QUADS)
    every = set(all_chains(facts, [0, 1], 9, False))
    last = defaultdict(lambda: -1)
    for s, r, o, t in facts:
        if r == 2:
            last[s, o] = max(last[s, o], t)
    exact = sum(last[e[0], e[-1]] > t[-1] for e, t in every) / len(every)
    got = rules.sampled_support(quads, 2, [0, 1], 4000, max_gap=9).first()
    assert got.body_supp <= min(4000, len(every)) and abs(got.rule_supp / got.body_supp - exact) < 0.06
    same = rules.sampled_support(quads, 2, [0, 1], 4000, max_gap=9, constraints=[[0, 2]]).first()
    assert same.body_supp <= sum(e[0] == e[2] for e, _ in every)
    assert tuple(rules.sampled_support(quads, 2, [9, 1], 100).first()) == (0, 0)


def test_causal_levels_on_executors_equal_the_plain_search(spark):
    rng = np.random.default_rng(6)
    n, k = 600, 24
    weight = np.triu(rng.random((k, k)) < 0.12, 1) * rng.uniform(0.5, 1.0, (k, k))
    x = np.zeros((n, k))
    for j in range(k):
        x[:, j] = x @ weight[:, j] + rng.standard_normal(n)
    names = [f"s{j:02d}" for j in range(k)]
    grid = spark.createDataFrame([(t, names[j], float(x[t, j])) for t in range(n) for j in range(k)], "t long, series string, value double")
    got = {tuple(r) for r in causal.causal_edges(grid, 0.01).collect()}
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-8)
    corr = np.corrcoef(z.T)
    assert got == set(causal.pc(names, corr, n, 0.01))
    level = causal.unlinked(corr, n, 0.01)
    assert all(level[i, j] == causal.apart(corr, n, i, j, (), 0.01) for i in range(k) for j in range(k) if i != j)


@pytest.mark.parametrize("seed", range(4))
def test_search_with_exact_independences_finds_the_graph(seed):
    """With the correlations of the model itself, the skeleton is the model's, and arrows that are given are right."""
    rng = np.random.default_rng(seed)
    k = 14
    weight = np.triu(rng.random((k, k)) < 0.2, 1) * rng.uniform(0.4, 1.0, (k, k))
    mixing = np.linalg.inv(np.eye(k) - weight)
    cov = mixing.T @ mixing
    scale = np.sqrt(np.diag(cov))
    names = [f"s{j:02d}" for j in range(k)]
    edges = causal.pc(names, cov / np.outer(scale, scale), 10**9, 1e-6)
    true = {(names[i], names[j]) for i, j in np.argwhere(weight > 0)}
    assert {frozenset(e[:2]) for e in edges} == {frozenset(e) for e in true}
    assert {e[:2] for e in edges if e[2] == "directed"} <= true


def test_orientation_rules():
    def near_of(k, pairs):
        near = np.zeros((k, k), bool)
        for i, j in pairs:
            near[i, j] = near[j, i] = True
        return near

    # a -> c <- b, then c - d: away from the collider
    assert causal.oriented(near_of(4, [(0, 2), (1, 2), (2, 3)]), {(0, 1): (), (0, 3): (2,), (1, 3): (2,)}) == ({(0, 2), (1, 2), (2, 3)}, set())
    # a chain stays undirected
    assert causal.oriented(near_of(3, [(0, 1), (1, 2)]), {(0, 2): (1,)}) == (set(), {(0, 1), (1, 2)})
    # two colliders against each other
    directed, undirected = causal.oriented(near_of(4, [(0, 1), (1, 2), (2, 3)]), {(0, 2): (), (1, 3): (), (0, 3): ()})
    assert undirected == {(1, 2)} and directed == {(0, 1), (3, 2)}


def test_early_stop_with_many_queries_in_a_task(spark):
    rng = np.random.default_rng(1)
    rows = [(int(q), p, int(c), float(rng.integers(1, 6)) / 10) for q in range(300) for p in range(8) for c in rng.choice(15, 4, replace=False)]
    by_query = defaultdict(list)
    for r in rows:
        by_query[r[0]].append(r)
    expected = set()
    for q, part in by_query.items():
        found = {}
        for p in range(8):
            for _, _, c, s in sorted(x for x in part if x[1] == p):
                found[c] = sorted([*found.get(c, []), s], reverse=True)
            top = sorted(found.items(), key=lambda x: (x[1], -x[0]), reverse=True)[:4]
            if len({tuple(s) for _, s in top}) >= 4:
                break
        expected |= {(q, c, round(1 - math.prod(1 - s for s in v), 9), len(v)) for c, v in found.items()}
    scores = spark.createDataFrame(rows, "query_id long, priority int, cand int, score double")
    for parts in (1, 5):
        got = {(r.query_id, r.cand, round(r.score, 9), r.n_rules) for r in reason.early_stop(scores.repartition(parts), 4).collect()}
        assert got == expected
    assert reason.early_stop(scores.limit(0), 4).count() == 0


def test_chains_over_a_hot_service(spark):
    rng = np.random.default_rng(9)
    rows = [(0, f"e{k}", "hot" if k % 5 else f"svc{k % 3}", int(rng.integers(0, 400)), int(rng.integers(0, 2)), k) for k in range(3000)]
    frame = spark.createDataFrame(rows, "minute_ts long, id string, service string, event_ts long, kind int, seq long")
    expected = Counter()
    for _, part in itertools.groupby(sorted(rows, key=lambda r: (r[2], r[3], r[4], r[5])), key=lambda r: r[2]):
        part = list(part)
        expected.update((a[1], b[1], b[3] - a[3]) for a, b in itertools.pairwise(part))
    for size in ("1", "64k"):  # many ranges, few ranges
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", size)
        got = graph.chained(frame, "service")
        assert Counter((r.src, r.dst, r.dt_seconds) for r in got.collect()) == expected
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert Counter(map(tuple, graph.precedes(frame, "service").collect())) == Counter(map(tuple, got.collect()))
    assert graph.chained(frame.filter("false"), "service").count() == 0


# Streams


def stream_rows(seed=0, n=900, services=2):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.integers(1_000_000, 1_020_000, n))
    kinds = rng.choice(["click", "view", "error"], n)
    value = np.where(rng.random(n) < 0.04, 60.0, rng.normal(10, 2, n))
    return [(k, int(x), int(rng.integers(0, services)), str(kinds[k]), None if k % 97 == 5 else float(value[k])) for k, x in enumerate(t)]


def written_events(spark, rows, folder, files, shuffle=True):
    """Rows (event_id, t, user_id, type, value) as files in order of arrival, at most a few seconds out of order."""
    import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(1)
    order = sorted(rows, key=lambda r: r[1] + (rng.integers(0, 200) if shuffle else 0))
    for k, part in enumerate(np.array_split(np.arange(len(order)), files)):
        part = [order[i] for i in part]
        at = [datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=r[1]) for r in part]
        columns = {"event_id": [r[0] for r in part], "ts": pa.array(at, pa.timestamp("us")), "user_id": [r[2] for r in part], "event_type": [r[3] for r in part], "value": pa.array([r[4] for r in part], pa.float64()), "props": pa.array([""] * len(part))}
        pq.write_table(pa.table(columns), f"{folder}/events-{k:03d}.parquet")


def plain_graph(rows, base_from, start, end, threshold=3.0):
    out, last = set(), {}
    series = defaultdict(list)
    for _, t, user, kind, value in rows:
        if base_from <= t < start and value is not None:
            series[user, kind].append(value)
    found = defaultdict(list)
    for i, t, user, kind, value in rows:
        if start <= t <= end:
            if kind == "error":
                found[user].append((t, 0, i, f"log:svc{user}:{i}"))
            v = series[user, kind]
            if value is not None and len(v) >= 5 and abs((value - np.mean(v)) / (np.std(v) or 1.0)) >= threshold:
                found[user].append((t, 1, t, f"met:svc{user}:{kind}:{t}"))
    for user, events_ in found.items():
        for t, rank, _, node in sorted(events_):
            minute = t - t % 60
            out.add((minute, f"svc:svc{user}", node, "has_log" if rank == 0 else "has_metric", None))
            if user in last and last[user][1] - last[user][1] % 60 == minute:
                out.add((minute, last[user][0], node, "precedes", t - last[user][1]))
            last[user] = (node, t)
    return out


WINDOW = (1_000_000, 1_010_000, 1_018_000)


@pytest.mark.parametrize("files", [1, 7])
def test_live_graph_equals_the_batch(spark, tmp_path, files):
    rows = stream_rows()
    written_events(spark, rows, tmp_path, files)
    made = live.appended(live.live_graph(events.source(spark, str(tmp_path)), *WINDOW), f"live{files}")
    got = {(r.minute_ts, r.src, r.dst, r.edge_type, r.dt_seconds) for r in made.collect()}
    assert got == plain_graph(rows, *WINDOW)
    assert {e[3] for e in got} == {"has_log", "has_metric", "precedes"}


def test_late_rows_and_restart(spark, tmp_path):
    rows = stream_rows(3)
    cut = 1_012_000
    first, second = [r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut]
    late = [(5000 + k, 1_011_000 - 400 * k, 0, "error", 10.0) for k in range(3)]  # behind the watermark by then
    source, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    written_events(spark, first, source, 3, shuffle=False)

    def go():
        return live.appended(live.live_graph(events.source(spark, str(source)), *WINDOW), "late", checkpoint, sink)

    go()
    (tmp_path / "more").mkdir()
    written_events(spark, sorted([*late, *second]), tmp_path / "more", 1, shuffle=False)
    (tmp_path / "more" / "events-000.parquet").rename(source / "events-900.parquet")
    got = [(r.minute_ts, r.src, r.dst, r.edge_type, r.dt_seconds) for r in go().collect()]
    assert len(got) == len(set(got)) and set(got) == plain_graph(rows, *WINDOW)


def test_recent_anomalies_are_bounded_and_expire(spark, tmp_path):
    rows = stream_rows(4, services=3)
    written_events(spark, rows, tmp_path, 5)
    wrong = defaultdict(list)
    for i, t, user, kind, _ in rows:
        if kind == "error":
            wrong[f"svc{user}"].append((t, i))
    kept = events.drain(live.recent_anomalies(events.source(spark, str(tmp_path)), keep=20), ["service"], "recent20")
    assert {r.service: r.ids for r in kept.collect()} == {s: ",".join(str(i) for _, i in sorted(v)[-20:]) for s, v in wrong.items()}
    kept = events.drain(live.recent_anomalies(events.source(spark, str(tmp_path)), keep=100, expire=600), ["service"], "expiring")
    end = max(r[1] for r in rows) - 300 - 600
    for r in kept.collect():
        assert [int(i) for i in r.ids.split(",") if i] == [i for t, i in sorted(wrong[r.service]) if t >= end][-100:]


def test_walk_cache_keeps_each_services_newest(spark, tmp_path):
    rows = stream_rows(5, services=3)
    (tmp_path / "in").mkdir()
    written_events(spark, rows, tmp_path / "in", 4, shuffle=False)
    found = events.source(spark, str(tmp_path / "in")).filter("type = 'error'").select("service", "t", F.col("event_id").alias("id"))

    def find(newest):
        return newest.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("path", F.concat_ws(">", "service", "id", "step"))

    for _ in range(2):  # the second run has nothing new
        live.cache_walks(found, find, str(tmp_path / "out"), "cache", str(tmp_path / "checkpoint")).awaitTermination()
    got = {(r.service, r.t, r.path) for r in live.cached_walks(spark, str(tmp_path / "out")).collect()}
    expected = set()
    for user in range(3):
        t, i = max((r[1], r[0]) for r in rows if r[2] == user and r[3] == "error")
        expected |= {(f"svc{user}", t, f"svc{user}>{i}>{k}") for k in range(2)}
    assert got == expected


def test_moments_merge():
    x = np.random.default_rng(0).normal(3, 2, 50)
    n, mean, squares = live.merged(live.merged(live.moments(x[:0]), live.moments(x[:13])), live.moments(x[13:]))
    assert n == 50 and math.isclose(mean, x.mean()) and math.isclose(squares / n, x.var())


# Batches of problems


def incident(seed):
    """A graph of 3 services over 40 minutes, with calls."""
    rng = np.random.default_rng(seed)
    nodes, edges = [], []
    for k in range(3):
        for m in range(40):
            nodes.append((f"svc:s{k}", "service", f"s{k}", None, None, None, None, 60 * m))
    last = {}
    for j in range(160):
        t, k = int(60 * j // 4 + rng.integers(0, 15)), int(rng.integers(0, 3))
        metric = bool(rng.random() < 0.6)
        z = round(float(rng.normal(0, 4)), 3) if metric else None
        name = f"{'met' if metric else 'log'}:s{k}:{j}"
        nodes.append((name, "metric_event" if metric else "log_event", f"s{k}", "cpu" if metric else None, None if metric else "ERROR", z, t, t - t % 60))
        edges.append((f"svc:s{k}", name, "has_metric" if metric else "has_log", 1.0, None, t - t % 60))
        if k in last:
            edges.append((last[k][0], name, "precedes", 1.0, t - last[k][1], last[k][1] - last[k][1] % 60))
        last[k] = (name, t)
    edges += [("svc:s0", "svc:s1", "calls", 1.0, None, 60 * m) for m in range(0, 40, 3)]
    return nodes, edges


def test_all_problems_end_as_each_by_itself(spark):
    from faultloom.operators import problems, rca

    nodes, edges = incident(2)
    n = spark.createDataFrame(nodes, "id string, node_type string, service string, metric string, severity string, zscore double, event_ts long, minute_ts long").cache()
    e = spark.createDataFrame(edges, "src string, dst string, edge_type string, weight double, dt_seconds long, minute_ts long").cache()
    asked = [("a", 600, "svc:s0"), ("c", 1800, nodes[125][0]), ("far", 90_000, "svc:s0"), ("none", 600, None)]
    found = problems.find_root_causes(n, e, spark.createDataFrame(asked, "problem string, center long, start string"), n_walks=30, n_biased=40, rounds=3).collect()
    assert [r.problem for r in sorted(found)] == sorted(a[0] for a in asked)
    for r in found:
        center, start = next((c, s) for p, c, s in asked if p == r.problem)
        if start is None:
            assert r.service == "unknown" and r.evidence_paths == []
            continue
        own = rca.find_root_cause(n, e, center, start, n_walks=30, n_biased=40, rounds=3).first()
        assert tuple(r)[1:4] == tuple(own)[:3] and math.isclose(r.confidence, own.confidence, abs_tol=1e-12)
        assert r.evidence_paths == own.evidence_paths and r.rules_used == own.rules_used
    assert any(r.evidence_paths for r in found) and {r.service for r in found} > {"unknown"}


def test_where_problems_begin(spark):
    from faultloom.operators import problems

    schema = "id string, node_type string, service string, metric string, severity string, zscore double, event_ts long, minute_ts long"
    nodes = [(f"m{t}{z}", "metric_event", "s", "cpu", None, float(z), t, t - t % 60) for t, z in ((100, 3), (130, -5), (6000, 9), (6010, 9), (9000, 4))]
    nodes += [("svc:s", "service", "s", None, None, None, None, m) for m in (60, 120, 9000)]
    asked = [("near", "1970-01-01 00:01 to 00:04 it broke"), ("median", "no time here"), ("far", "on 1970-01-01 at 20:00"), ("null", None)]
    frame = spark.createDataFrame(asked, "problem string, instruction string")
    got = {r.problem: tuple(r)[1:] for r in problems.chosen(frame, spark.createDataFrame(nodes, schema), 5, 0).collect()}
    assert got == {"near": (60, "m130-5", "text", "window"), "median": (6000, "m60009", "median", "window"), "far": (72_000, "m60009", "text", "graph"), "null": (6000, "m60009", "median", "window")}
    quiet = spark.createDataFrame([n for n in nodes if n[1] == "service"], schema)
    assert {tuple(r)[2:] for r in problems.chosen(frame, quiet, 5, 0).collect()} == {("svc:s", "text", "service"), ("svc:s", "median", "service")}
    assert {r.start for r in problems.chosen(frame, quiet.filter("false"), 5, 0).collect()} == {None}


# Stores and neighbourhoods


def test_minute_store_rewrites_only_what_changed(spark, tmp_path):
    import os

    from faultloom.sources import store

    nodes, edges = incident(4)
    schema = "id string, node_type string, service string, metric string, severity string, zscore double, event_ts long, minute_ts long"
    n, e = spark.createDataFrame(nodes, schema), spark.createDataFrame(edges, "src string, dst string, edge_type string, weight double, dt_seconds long, minute_ts long")
    folder = str(tmp_path / "store")
    assert store.manifest(spark, folder).count() == 0
    assert store.merge(n, e, folder).count() == len({x[-1] for x in nodes})
    assert store.merge(n, e, folder).count() == 0 and store.changed(spark, folder, n.repartition(3), e, True).count() == 0
    before = {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, files in os.walk(folder) for f in files if f.startswith("part-")}
    more = n.filter("minute_ts <> 120").unionByName(spark.createDataFrame([("met:new", "metric_event", "s1", "cpu", None, 5.0, 310, 300)], schema))
    kept = e.filter("minute_ts <> 120 and not (minute_ts = 600 and edge_type = 'precedes')")
    rewritten = {r.minute_ts: r for r in store.merge(more, kept, folder, whole=True).collect()}
    assert set(rewritten) <= {120, 300, 600} and {120, 300} <= set(rewritten) and rewritten[120].nodes_count == 0
    after = {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, files in os.walk(folder) for f in files if f.startswith("part-")}
    same = set(before) & set(after)
    assert len(same) > 60 and all(before[f] == after[f] for f in same)
    for center, minutes in ((300, 2), (1200, 40)):
        got_n, got_e = store.window(spark, folder, center, minutes)
        inside = F.col("minute_ts").between(center - 60 * minutes, center + 60 * minutes)
        assert Counter(map(tuple, got_n.select(*more.columns).collect())) == Counter(map(tuple, more.filter(inside).collect()))
        assert Counter(map(tuple, got_e.select(*kept.columns).collect())) == Counter(map(tuple, kept.filter(inside).collect()))
        assert "PartitionFilters: [isnotnull(minute_ts" in got_n._jdf.queryExecution().toString()
    assert {r.minute_ts: (r.nodes_count, r.edges_count) for r in store.manifest(spark, folder).collect()} == {m: (c, Counter(r.minute_ts for r in kept.select("minute_ts").collect())[m]) for m, c in Counter(r.minute_ts for r in more.select("minute_ts").collect()).items()}


def test_capped_neighbourhood_is_the_same_in_every_run(spark):
    from faultloom.operators import quads

    facts = spark.createDataFrame([(a, 0, b, 0) for a in range(40) for b in (a + 1, 2 * a, 3 * a + 1, 0)], QUADS)
    start = spark.createDataFrame([(0,)], "id int")
    every = {r.id: r.hop for r in quads.hop_neighbourhood(facts, start, 3).collect()}
    runs = [sorted(map(tuple, quads.hop_neighbourhood(facts.repartition(p), start, 3, cap=4).collect())) for p in (1, 5)]
    assert runs[0] == runs[1] and Counter(h for _, h in runs[0]) == {0: 1, 1: 4, 2: 4, 3: 4}
    assert all(h >= every[i] for i, h in runs[0]) and len({i for i, _ in runs[0]}) == 13
    assert sorted(map(tuple, quads.hop_neighbourhood(facts, start, 3, cap=4, seed=1).collect())) != runs[0]
    whole = {r.id: r.hop for r in quads.hop_neighbourhood(facts, start, 3, cap=1000).collect()}
    assert whole == every


def test_triples_by_probability_and_by_number(spark, tmp_path):
    from faultloom.sources import readers

    rows = spark.createDataFrame([(f"a{k}", f"r{k % 3}", f"b{k % 50}") for k in range(1000)], "s string, r string, o string")
    rows.repartition(1).write.csv(str(tmp_path / "one"), sep="\t")
    rows.repartition(6).write.csv(str(tmp_path / "six"), sep="\t")
    for options in ({"sparsity": 0.3}, {"exactly": 77}, {"sparsity": 0.5, "exactly": 100, "seed": 3}):
        one, six = (set(map(tuple, readers.triple_tsv(spark, str(tmp_path / f), **options).collect())) for f in ("one", "six"))
        assert one == six and (len(one) == options["exactly"] if "exactly" in options else 230 < len(one) < 370)


# Packing, summaries, stages


def test_packs_by_prefix_sums(spark):
    from faultloom.operators import tokens

    rng = np.random.default_rng(3)
    rows = [(f"k{k % 3}", int(i), " ".join(["w"] * int(n))) for i, (k, n) in enumerate(zip(rng.integers(0, 7, 400), rng.integers(0, 30, 400), strict=True))]
    rows += [("long", 0, "w " * 500), ("long", 1, "w"), ("null", 0, None), ("same", 1, "a b"), ("same", 1, "a b")]
    got = tokens.packs(spark.createDataFrame(rows, "key string, seq int, text string"), 40).collect()
    assert Counter((r.key, r.seq, r.text) for r in got) == Counter(rows)
    held = defaultdict(list)
    for r in got:
        held[r.key, r.pack].append((r.seq, len((r.text or "").split())))
    assert all(sum(n for _, n in v) <= 40 or len(v) == 1 for v in held.values())
    for key in {r[0] for r in rows}:  # packs follow each other in the order of seq, and there are at most twice as many as need be
        packs = sorted(p for k, p in held if k == key)
        assert all(max(held[key, a])[0] <= min(held[key, b])[0] for a, b in itertools.pairwise(packs))
        assert len(packs) <= 2 * (sum(n for p in packs for _, n in held[key, p]) // 40) + 2


class Halving:
    """Answers with every second rule, and notes the prompts in a folder."""

    def __init__(self, folder):
        self.folder = folder

    def complete(self, prompt):
        import uuid

        (self.folder / uuid.uuid4().hex).write_text(prompt)
        return "\n".join(["Here they are:", *[line for line in prompt.splitlines() if "(X0" in line][::2]])


def test_summaries_in_levels(spark, tmp_path):
    from faultloom.plans import sessions

    rules_of = lambda head, n: [(head, f"{head}(X0,X1,T1)<-b{k:03d}(X0,X1,T0)") for k in range(n)]
    rows = rules_of("big", 60) + rules_of("small", 3)
    got = sessions.summaries(spark.createDataFrame(rows, "head string, rule string"), lambda: Halving(tmp_path), 40)
    found = defaultdict(set)
    for r in got.collect():
        found[r.head].add((r.rule, r.level))
    prompts = [p.read_text() for p in tmp_path.iterdir()]
    assert all(any(rule in p for p in prompts) for _, rule in rows)
    assert all(len(p.split()) <= 40 for p in prompts)
    assert {level for _, level in found["small"]} == {1} and len(found["small"]) == 2
    assert len({level for _, level in found["big"]}) == 1 and next(iter(found["big"]))[1] > 1 and len(found["big"]) < 20
    assert {rule for rule, _ in found["big"]} <= {rule for _, rule in rows}
    with pytest.raises(ValueError, match="no room"):
        sessions.summaries(spark.createDataFrame(rows, "head string, rule string"), lambda: Halving(tmp_path), 5)


def test_rule_stage_says_what_became_of_each_line(spark):
    from faultloom.plans import sessions

    lines = [
        ("a", "1. visit(X0,X1,T1)<-meet(X0,X1,T0)"), ("a", "visit(X0,X1,T1)<-meeet(X0,X1,T0)"), ("a", "visit(X0,X1,T1)<-qqqqzzzz(X0,X1,T0)"), ("a", "Sure!"), ("a", None), ("a", "visit(X0,X2,T2)<-meet(X0,X1,T0)&call(X3,X2,T1)"), ("b", "2) visit(X0,X1,T1)<-meet(X0,X1,T0)"),
    ]
    got = {(r.head, r.rule): (r.status, r.reason) for r in sessions.rule_stage(spark.createDataFrame(lines, "head string, rule string"), ["visit", "meet", "call"]).collect()}
    assert len(got) == len(lines)
    assert sorted(got["a", x][0] for _, x in lines[:2]) == ["kept", "repeated"] and got["b", lines[6][1]] == ("kept", None)
    assert [got["a", x][1] for _, x in lines[2:6]] == ["unknown relation", "no rule", "no rule", "no chain"]
    assert sessions.rule_stage(spark.createDataFrame([], "head string, rule string"), ["visit"]).count() == 0


@pytest.mark.parametrize("max_len", [1, 2, 3])
def test_closed_relation_paths(spark, max_len):
    facts = sorted({f[:3] for f in some_facts(11, n=70, entities=8)})
    out = defaultdict(set)
    for s, r, o in facts:
        out[s].add((r, o))

    def paths(s, r, o):
        found = set()

        def go(at, path, seen):
            if at == o:
                if path != (r,):
                    found.add(path)
                return
            if len(path) < max_len:
                for rel, to in out[at]:
                    if to not in seen:
                        go(to, (*path, rel), {*seen, to})

        go(s, (), {s})
        return found

    expected = Counter((r, p) for s, r, o in facts if s != o for p in paths(s, r, o))
    triples = spark.createDataFrame(facts, "s int, r int, o int")
    assert {(x.r, tuple(x.path)): x.n for x in rules.closed_relation_paths(triples, triples, max_len).collect()} == dict(expected)


def test_evaluated_rules(spark):
    facts = some_facts(5, n=150)
    quads = spark.createDataFrame(facts, QUADS)
    asked = [(0, [1], []), (2, [1, 2], []), (0, [1, 2], [[0, 2]]), (0, [7, 1], []), (9, [1], None)]
    rows = rules.evaluated(spark.createDataFrame(asked, "head_rel int, body_rels array<int>, var_constraints array<array<int>>"), quads, 6, 2).collect()
    got = {(r.head_rel, tuple(r.body_rels), tuple(map(tuple, r.var_constraints))): (r.body_supp, r.rule_supp, r.conf) for r in rows}
    assert len(got) == len(asked) and got[0, (7, 1), ()] == (0, 0, 0.0) and got[9, (1,), ()][1:] == (0, 0.0) and got[9, (1,), ()][0] > 0
    for r in rules.chain_rules(quads, 1, 6).unionByName(rules.chain_rules(quads, 2, 6)).collect():
        key = (r.head_rel, tuple(r.body_rels), tuple(map(tuple, r.var_constraints)))
        assert key not in got or got[key] == (r.body_supp, r.rule_supp, r.conf)


def test_length_two_rules_in_tiles(spark, monkeypatch):
    """Chains are counted in many small tiles and pieces, and never become rows."""
    rng = random.Random(8)
    facts = sorted({(rng.randrange(12), rng.randrange(4), rng.randrange(12), rng.randrange(40)) for _ in range(700)})
    for name, value in (("TILE", 100), ("WALKS", 7), ("CELLS", 30)):
        monkeypatch.setattr(rules, name, value)
    last = {}
    for s, r, o, t in facts:
        last[s, o, r] = max(t, last.get((s, o, r), -1))
    body, hit = Counter(), Counter()
    for s, r, o, t in facts:
        for s2, r2, o2, t2 in facts:
            if o == s2 and t <= t2 <= t + 5:
                body[r, r2] += 1
                hit.update((h, r, r2) for h in range(4) if last.get((s, o2, h), -1) > t2)
    quads = spark.createDataFrame(facts + facts[:50], "s int, r int, o int, t int")
    plans = []
    monkeypatch.setattr(rules, "cut", lambda df, name, cut=rules.cut: (plans.append((name, df)), cut(df, name))[1])
    got = {(x.head_rel, x.b0, x.b1): (x.body_supp, x.rule_supp) for x in rules.length_two_rules(quads, 5).collect()}
    assert got == {(h, a, b): (body[a, b], n) for (h, a, b), n in hit.items()}
    assert rules.length_two_rules(quads.filter("t < 0"), 5).count() == 0
    support = next(df for name, df in plans if name == "support")
    assert "Join" not in support._jdf.queryExecution().optimizedPlan().toString()


def test_support_of_one_rule_makes_no_chain_rows(spark, monkeypatch):
    facts = some_facts(9)
    made = []
    monkeypatch.setattr(rules, "chain", lambda *a, **k: made.append(a))
    last = {}
    for s, r, o, t in facts:
        last[s, o, r] = max(t, last.get((s, o, r), -1))
    walks = [(a, c) for a in facts for c in facts if a[1] == 0 and c[1] == 2 and a[2] == c[0] and a[3] <= c[3] <= a[3] + 6]
    hits = sum(last.get((a[0], c[2], 1), -1) > c[3] for a, c in walks)
    got = rules.rule_support(spark.createDataFrame(facts + facts[:9], QUADS), 1, [0, 2], (), 6).first()
    assert (got.body_supp, got.rule_supp, got.body_rels) == (len(walks), hits, [0, 2]) and not made
    none = rules.rule_support(spark.createDataFrame(facts, QUADS), 1, [0, 77], (), 6).first()
    assert (none.body_supp, none.rule_supp, none.conf) == (0, 0, 0.0)


def test_closed_paths_of_an_entity_with_itself(spark):
    quads = spark.createDataFrame([(1, 0, 1, 5), (1, 1, 2, 5), (2, 2, 1, 5), (2, 3, 3, 5), (3, 4, 1, 5), (3, 5, 2, 5)], QUADS)
    pairs = spark.createDataFrame([(1, 1), (1, 3)], "s int, o int")
    got = {(r.s, r.o, tuple(r.path)) for r in rules.closed_paths(quads, pairs, 3).collect()}
    assert got == {(1, 1, (1, 2)), (1, 1, (1, 3, 4)), (1, 3, (1, 3))}


def test_pairs_in_windows_equal_joined_maps(spark):
    """Candidates beside the objects of their windows: as by a join of both maps, but the wide rows aren't shuffled."""
    quads = spark.createDataFrame(some_facts(10), QUADS)
    queries = spark.createDataFrame([(k, k % 5, 3 + 4 * k) for k in range(10)], "query_id long, s int, t int")
    cands = spark.createDataFrame([(k, c, 0.1 * c + 0.01 * k) for k in range(8) for c in (0, 3, 7, 50 + k)], "query_id long, cand int, score double")
    made = expand.pairs_in_windows(cands, queries, quads, 6)
    recency = expand.window_recency(queries, quads, 6)
    rows = lambda df: sorted((r.query_id, r.cand, round(r.score, 9)) for r in df.collect())
    assert rows(expand.scaled(made)) == rows(expand.expand_scaled(cands, recency))
    assert rows(expand.summed(made)) == rows(expand.expand_added(cands, recency))
    assert rows(expand.merged_models(made, 0.4)) == rows(expand.merge_models(cands, recency, 0.4))
    assert rows(expand.preferred(made)) == rows(expand.prefer(recency, cands))
    assert "FullOuter" not in made._jdf.queryExecution().optimizedPlan().toString()
