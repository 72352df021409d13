"""The five-node incident graph and its known values."""

import math

import pytest
from pyspark.sql import functions as F

from faultloom.operators import graph, ranking, rca, walks
from faultloom.plans import sessions

M = 1_614_868_260  # 2021-03-04 14:31:00
CPU, MEM, LOG = "met:payment:CPU", "met:payment:Memory", "log:payment:HTTP_500_ERROR"
T = {CPU: M + 15.123, MEM: M + 45.456, LOG: M + 70.789}


@pytest.fixture(scope="module")
def incident(spark):
    nodes = spark.createDataFrame(
        [("svc:payment", "service", "payment", None, None, None, None, M), ("svc:database", "service", "database", None, None, None, None, M),
         (CPU, "metric_event", "payment", "CPU", None, 3.5, T[CPU], M), (MEM, "metric_event", "payment", "Memory", None, 2.8, T[MEM], M),
         (LOG, "log_event", "payment", None, "ERROR", None, T[LOG], M + 60)],
        "id string, node_type string, service string, metric string, severity string, zscore double, event_ts double, minute_ts long",
    )
    edges = spark.createDataFrame(
        [("svc:payment", CPU, "has_metric", 1.0, M), ("svc:payment", MEM, "has_metric", 1.0, M), ("svc:payment", LOG, "has_log", 1.0, M + 60),
         (CPU, MEM, "precedes", 1.0, M), (MEM, LOG, "precedes", 1.0, M), ("svc:payment", "svc:database", "calls", 0.8, M)],
        "src string, dst string, edge_type string, weight double, minute_ts long",
    )
    return nodes, edges


def test_edge_weights(spark):
    rows = spark.createDataFrame([(T[MEM] - T[CPU], 0.0023), (T[LOG] - T[MEM], 0.0063), (15.123, 0.0486), (45.456, 0.0001)], "gap double, known double")
    got = rows.select(walks.edge_weight(F.lit(1.0), F.lit(1.0), F.col("gap"), 0.2).alias("w"), "known").collect()
    assert all(abs(r.w - r.known) < 5e-5 for r in got)


def test_one_walk_from_cpu(spark, incident):
    typed = rca.with_types(*incident)
    got = walks.random_walks(typed, spark.createDataFrame([(CPU,)], "id string"), n_walks=50).collect()
    assert [r.path for r in got] == [[CPU, MEM, LOG]]


def test_walks_keep_the_rules(spark, incident):
    typed = rca.with_types(*incident)
    edges = {(r.src, r.dst) for r in typed.collect()}
    starts = spark.createDataFrame([("svc:payment",)], "id string")
    a = walks.random_walks(typed, starts, n_walks=300, rate=0.0).collect()
    assert sorted(map(str, a)) == sorted(map(str, walks.random_walks(typed, starts, n_walks=300, rate=0.0).collect()))
    for r in a:
        assert all(p in edges for p in zip(r.path, r.path[1:])) and len(set(r.path)) == len(r.path)
        times = [T[v] for v in r.path if v in T]
        assert times == sorted(times)
    # The database has the time of its minute, which isn't later than the start's.
    assert {r.path[1] for r in a} == {CPU, MEM, LOG}


def test_walks_agree_over_partitions(spark, incident):
    typed = rca.with_types(*incident)
    starts = spark.createDataFrame([("svc:payment",), (CPU,)], "id string")
    runs = [sorted(map(str, walks.random_walks(typed.repartition(n), starts.repartition(n), n_walks=100, rate=0.0).collect())) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 2


def test_walks_follow_a_type_sequence(spark, incident):
    typed = rca.with_types(*incident)
    starts = spark.createDataFrame([("svc:payment",)], "id string")
    kinds = ("service", "metric_event", "log_event")
    got = {tuple(r.path) for r in walks.random_walks(typed, starts, n_walks=300, rate=0.0, types=kinds).collect()}
    assert got == {("svc:payment", CPU), ("svc:payment", MEM, LOG)}
    assert walks.random_walks(typed, starts, n_walks=20, types=("log_event",)).count() == 0


def test_parallel_edges_add_their_weights(spark):
    rows = [("a", "b", "calls", 0.0, 1.0, "x", "x")] * 3 + [("a", "c", "calls", 0.0, 1.0, "x", "x"), ("a", "d", "precedes", 0.0, 1.0, "x", "x")]
    edges = spark.createDataFrame(rows, "src string, dst string, edge_type string, src_ts double, dst_ts double, src_type string, dst_type string").withColumn("weight", F.lit(1.0))
    starts = spark.range(3000).select(F.concat(F.lit("a"), F.col("id")).alias("id"))
    many = edges.crossJoin(starts).withColumn("src", F.col("id")).drop("id")
    counts = {r.to: r["count"] / 3000 for r in walks.random_walks(many, starts, n_walks=1, max_len=2).groupBy(F.get("path", F.lit(1)).alias("to")).count().collect()}
    assert abs(counts["b"] - 1.8 / 3.4) < 0.04 and abs(counts["c"] - 0.6 / 3.4) < 0.04 and abs(counts["d"] - 1.0 / 3.4) < 0.04


def test_choice_follows_weights(spark):
    edges = spark.createDataFrame([("a", "b", "calls", 3.0, None, None), ("a", "c", "calls", 1.0, None, None)], "src string, dst string, edge_type string, weight double, src_ts double, dst_ts double")
    starts = spark.createDataFrame([("a",)], "id string")
    counts = {}
    for seed in range(4):
        picked = walks.random_walks(edges, starts, n_walks=1, max_len=2, seed=seed, monotonic=False)
        for r in picked.collect():
            counts[r.path[1]] = counts.get(r.path[1], 0) + 1
    u = spark.range(20_000).select(*[(F.log(F.lit(w)) - F.log(-F.log(walks._uniform(F.col("id"), F.lit(k))))).alias(k) for k, w in (("b", 3.0), ("c", 1.0))])
    assert abs(u.filter("b > c").count() / 20_000 - 0.75) < 0.015 and sum(counts.values()) == 4


def test_rules_bias_and_scores(spark, incident):
    nodes, edges = incident
    paths = spark.createDataFrame([(0, [CPU, MEM, LOG])], "path_id long, path array<string>")
    learned = rca.pattern_rules(paths, nodes, edges)
    got = {(r.src_type, r.edge_type, r.dst_type): (r.support, r.confidence) for r in learned.collect()}
    assert got == {("metric_event", "precedes", "metric_event"): (1, 0.5), ("metric_event", "precedes", "log_event"): (1, 0.5)}
    bias = rca.rules_to_bias(learned)
    assert all(math.isclose(r.bias, 1.225) for r in bias.collect())
    assert all(math.isclose(r.bias, 1.0675) for r in rca.accumulate_bias(bias.limit(0), bias).collect())
    scored = rca.score_services(paths, nodes)
    row = scored.first()
    assert math.isclose(row.score, 1.41) and math.isclose(row.confidence, 0.141)
    best = rca.best_root_cause(scored).first()
    assert (best.service, best.reason) == ("payment", "metric_anomaly") and math.isclose(best.time, T[CPU])


def test_loop_finds_payment(spark, incident):
    nodes, edges = incident
    found = rca.find_root_cause(nodes.withColumn("event_ts", F.col("event_ts").cast("long")), edges, M, CPU, rounds=2, n_walks=20, n_biased=20).first()
    assert (found.service, found.reason) == ("payment", "metric_anomaly") and found.confidence > 0.14
    assert found.evidence_paths == [[CPU, MEM, LOG]] and found.rules_used == ["metric_event>precedes>log_event", "metric_event>precedes>metric_event"]
    none = rca.find_root_cause(nodes.limit(0), edges.limit(0), M, CPU, rounds=2, n_walks=5, n_biased=5).first()
    assert (none.service, none.reason, none.confidence, none.evidence_paths) == ("unknown", "no_evidence", 0.0, [])


def test_sampled_cyclic_walks(spark):
    facts = [(1, 0, 2, 10), (2, 1, 1, 9), (2, 1, 1, 2), (2, 2, 3, 5), (3, 1, 1, 4), (2, 4, 1, 10), (3, 1, 1, 7)]  # 4 is the inverse of 0 for four relations
    q = spark.createDataFrame(facts, "s int, r int, o int, t int")
    every = {str((r.entities, r.relations, r.times)) for r in walks.cyclic_walks(q, 4, 2, 10**6).collect()}
    drawn = walks.sample_cyclic_walks(q, 4, 2, n_walks=200)
    rows = drawn.collect()
    assert {str((r.entities, r.relations, r.times)) for r in rows} <= every
    assert sorted(map(str, rows)) == sorted(map(str, walks.sample_cyclic_walks(q.repartition(5), 4, 2, n_walks=200).collect()))
    one = walks.sample_cyclic_walks(q, 4, 1, n_walks=4000).filter("r = 0").groupBy(F.get("times", F.lit(1)).alias("t")).count().collect()
    share = {r.t: r["count"] / 4000 for r in one}
    assert set(share) <= {9, 2} and share[9] > 0.99  # exp(-1) against exp(-8)
    flat = walks.sample_cyclic_walks(q, 4, 1, n_walks=4000, transition="unif").filter("r = 0").groupBy(F.get("times", F.lit(1)).alias("t")).count().collect()
    assert all(abs(r["count"] / 4000 - 0.5) < 0.04 for r in flat) and len(flat) == 2
    far = spark.createDataFrame([(1, 0, 2, 10_000), (2, 1, 1, 9), (2, 1, 1, 2)], "s int, r int, o int, t int")
    assert walks.sample_cyclic_walks(far, 4, 1, n_walks=400).filter("r = 0").select("times").distinct().count() == 2
    relaxed = {str((r.entities, r.relations, r.times)) for r in walks.cyclic_walks(q, 4, 2, 10**6, relaxed=True).collect()}
    assert every < relaxed and "([1, 2, 3, 1], [0, 2, 1], [10, 5, 7])" in relaxed


def test_window_index_and_validation(incident):
    nodes, edges = incident
    n, e = graph.window_subgraph(nodes, edges, M, 0)
    assert (n.count(), e.count()) == (4, 5)
    assert [(r.minute_ts, r.nodes_count, r.edges_count) for r in graph.index(nodes, edges).orderBy("minute_ts").collect()] == [(M, 4, 5), (M + 60, 1, 1)]
    v = graph.edge_times(nodes.withColumn("minute_ts", F.lit(0)), edges.withColumn("minute_ts", F.lit(0)).filter("edge_type = 'precedes'")).collect()
    assert all(r.src_ts < r.dst_ts and r.event_ts == r.src_ts for r in v)


def test_component_scores(incident):
    nodes, edges = incident
    rows = {r.id: r for r in ranking.component_scores(nodes, edges.withColumn("dt_seconds", F.lit(10))).collect()}
    p = rows["svc:payment"]
    assert (p["self"], p.impact, p.spread, p.latency) == (3.0, 1.0, 1.0, 10.0) and math.isclose(p.score, 0.4 * 3 + 0.3 + 0.2 + 1.0)
    assert rows["svc:database"].score == 0


class Stub:
    def __init__(self, answers):
        self.answers = iter(answers)

    def complete(self, prompt):
        return next(self.answers)


def test_sessions(spark, incident):
    nodes, edges = incident
    got = sessions.evidence_session(nodes, edges, M, Stub(['{"action": "continue", "center": %d}' % (M + 60), '{"action": "stop", "service": "payment", "confidence": 0.9}']))
    assert got == {"centers": [M, M + 60], "service": "payment", "confidence": 0.9}
    assert sessions.evidence_session(nodes, edges, M, Stub(["no json"]))["service"] == "unknown"
    heads = spark.createDataFrame([("visit", ["a"])], "head string, examples array<string>")
    made = sessions.generate_rules(heads, lambda: Stub(["1. visit(X0,X2,T2)<-meet(X0,X1,T0)&call(X1,X2,T1)\n2. visit(X0,X2,T1)<-cal(X0,X1,T1)&meet(X1,X2,T0)\nwords"]), ["visit", "meet", "call"])
    kept, rejected = sessions.clean_rules(made, ["visit", "meet", "call"])
    assert [r.rule for r in kept.collect()] == ["visit(X0,X2,T2)<-meet(X0,X1,T0)&call(X1,X2,T1)"]
    assert rejected.count() == 1
    client = sessions.Retrying(Stub(["x"]))
    assert client.complete("p") == "x" and client.calls == 1
