"""Link prediction: rules applied to queries, scores, and their combination."""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator
from functools import reduce
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultloom.sources.shared import cut


def confidence_score(conf: Column, llm: Column, kind: str, weight: float = 0.5) -> Column:
    """Common: the counted confidence; llm: the model's; or: the larger; else the weighted mix."""
    if kind == "common":
        return conf
    if kind == "llm":
        return llm
    return F.greatest(conf, llm) if kind == "or" else weight * conf + (1 - weight) * llm


def decay(last: Column, now: Column, rate: float) -> Column:
    """exp(rate * (last - now)): 1 for now, less for earlier."""
    return F.exp(F.lit(rate) * (last - now))


def mixed_score(s1: Column, s2: Column, a: float, weight: float = 0.0, corr: Column | None = None) -> Column:
    """a * s1 + (1 - a) * s2 + weight * corr."""
    out = F.lit(a) * s1 + F.lit(1 - a) * s2
    return out if corr is None else out + F.lit(weight) * corr


def scaled_score(s1: Column, s2: Column, a: float, corr: Column) -> Column:
    """a * s1 * corr + (1 - a) * s2."""
    return F.lit(a) * (s1 * corr) + F.lit(1 - a) * s2


def score_of(mode: str, conf: Column, first: Column, last: Column, now: Column, a: float, rate: float, corr: Column | None = None) -> Column:
    """The score of a walk by mode: ``origin`` decays by its first fact, ``end`` by its last one, and
    ``transformer`` scales the confidence by corr as well (decay by the first fact)."""
    if mode == "transformer":
        return scaled_score(conf, decay(first, now, rate), a, F.lit(1.0) if corr is None else corr)
    if mode not in ("origin", "end"):
        raise ValueError(f"mode {mode!r} is none of origin, transformer, end")
    return mixed_score(conf, decay(first if mode == "origin" else last, now, rate), a)


def frontier(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose subject is among the entities (id)."""
    return edges.join(entities.select(F.col("id").alias("s")).distinct(), "s", "left_semi").select("s", "r", "o", "t")


def rule_tree(rules: DataFrame, max_length: int) -> tuple[DataFrame, DataFrame]:
    """(steps, leaves) of the prefix tree of all rules' bodies, a tree for each head.

    rules (rule_id, head_rel, body_rels, var_constraints). A step leads from a node ``parent`` to ``node``, over relation
    ``rel``, at depth ``hop``. Where a variable constraint makes its end an entity met before, ``same`` is the place at
    which that entity stood first (0 is the query's subject), so rules share a node only if they agree in their
    constraints so far. ``keep`` lists the places after 0 whose entities steps further down ask for, ``had`` those of
    the parent. leaves (node, rule_id, ...) are the nodes at which rules end. A body longer than ``max_length`` is an error.
    """
    too_long = F.raise_error(F.format_string("a body of %d relations; the longest allowed is %d", F.size("body_rels"), F.lit(max_length)))
    body = F.when(F.size("body_rels") > max_length, too_long.cast("array<int>")).otherwise(F.col("body_rels").cast("array<int>"))
    first = lambda k: F.array_min(F.get(F.filter(F.coalesce("var_constraints", F.array().cast("array<array<int>>")), lambda g: F.array_contains(g, k)), F.lit(0)))
    steps = F.transform(body, lambda r, i: F.struct(r.alias("rel"), F.when(first(i + 1) < i + 1, first(i + 1)).cast("int").alias("same")))
    coded = rules.withColumn("_steps", steps).withColumn("_codes", F.transform("_steps", lambda x: F.concat_ws("=", x["rel"].cast("string"), x["same"].cast("string"))))
    node = lambda n: F.concat_ws("/", F.col("head_rel").cast("string"), F.slice("_codes", F.lit(1), n))
    hops = coded.select("head_rel", "_steps", "_codes", F.posexplode("_steps").alias("i", "step"))
    asked = lambda n: F.array_sort(F.filter(F.transform(F.slice("_steps", n + 1, F.size("_steps")), lambda x: x["same"]), lambda p: (p > 0) & (p <= n)))
    hops = hops.select(node(F.col("i")).alias("parent"), node(F.col("i") + 1).alias("node"), (F.col("i") + 1).alias("hop"), "step.rel", "step.same", asked(F.col("i") + 1).alias("keep"), asked(F.col("i")).alias("had"))
    both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    kept = hops.groupBy("node", "parent", "hop", "rel", "same").agg(both("keep").alias("keep"))
    had = hops.groupBy(F.col("parent").alias("node")).agg(both("had").alias("had"))
    leaves = coded.withColumn("node", node(F.size("_codes"))).drop("_steps", "_codes", "head_rel", "body_rels", "var_constraints")
    return kept.join(had.withColumnRenamed("node", "parent"), "parent"), leaves


def _hop(state: DataFrame, steps: DataFrame, facts: DataFrame, hop: int, window: int, relaxed: bool) -> DataFrame:
    """The frontier one step on: joined to the steps below its nodes, then to facts by (entity, relation, slot of time)."""
    slot = F.floor(F.col("q_t") / window)
    way = state.join(steps.filter(F.col("hop") == hop).drop("hop"), state["node"] == steps["parent"]).drop(state["node"], "parent")
    way = way.withColumn("slot", F.explode(F.array(slot, slot - 1)))
    way = way.join(facts, ["at", "rel", "slot"]).filter((F.col("ts") < F.col("q_t")) & (F.col("ts") >= F.col("q_t") - window))
    if hop > 1 and not relaxed:
        way = way.filter(F.col("ts") >= F.col("last"))
    held = lambda p: F.get("held", F.array_position("had", p) - 1)
    before = F.when(F.col("same") == 0, F.col("q_s")).otherwise(held(F.col("same")))
    way = way.filter(F.col("same").isNull() | (F.col("to") == before))
    return way.withColumn("held", F.transform("keep", lambda p: F.when(p == hop, F.col("to")).otherwise(held(p))))


def _started(queries: DataFrame, rules: DataFrame, quads: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    heads = rules.select(F.col("head_rel").alias("r")).distinct()
    state = queries.join(heads, "r").select("query_id", F.col("s").alias("q_s"), F.col("t").alias("q_t"), F.col("r").cast("string").alias("node"), F.col("s").alias("at"))
    facts = quads.select(F.col("s").alias("at"), F.col("r").alias("rel"), F.col("o").alias("to"), F.col("t").alias("ts"), F.floor(F.col("t") / window).alias("slot"))
    return state.withColumn("held", F.array().cast("array<int>")), facts


def apply_rules(
    queries: DataFrame, rules: DataFrame, quads: DataFrame, window: int, a: float = 0.5, rate: float = 0.1, mode: str = "origin", max_length: int = 3, relaxed: bool = False, min_length: int = 1,
) -> DataFrame:
    """(query_id, rule_id, cand, score) of rules with bodies of any length up to ``max_length`` and variable constraints.

    queries (query_id, s, r, t); rules (rule_id, head_rel, body_rels, var_constraints, conf). Facts come from each query's
    window, with non-decreasing times (any times if ``relaxed``). All rules and queries walk together, one frontier join a
    level of the rules' prefix tree: walks of a query that stand at the same node, entity and time and hold the same
    entities for later constraints are one row, with the latest of their first facts. So a level has at
    most as many rows for a query and node as facts can be reached, however many walks lead there.

    The score is that of ``score_of``, over the latest first and last facts of the walks; ``transformer`` takes
    the column corr of the rules. Scores are made before rows move (no score falls as its fact gets later, or none
    rises, so the best row has it), and move once, by query: what sums them up by query and candidate moves nothing.
    The first step is summed up by no one, as there each fact is one walk, nor is the last one but by its candidates.
    """
    steps, leaves = rule_tree(rules.select("rule_id", "head_rel", "body_rels", "var_constraints", "conf", (F.col("corr") if "corr" in rules.columns else F.lit(1.0)).alias("corr")), max_length)
    state, facts = _started(queries, rules, quads, window)
    score = score_of(mode, F.col("conf"), F.col("t0"), F.col("last"), F.col("q_t"), a, rate, F.col("corr"))
    found = []
    for hop in range(1, max_length + 1):
        way = _hop(state, steps, facts, hop, window, relaxed)
        begun = F.col("ts") if hop == 1 else F.col("t0")
        keys = ["query_id", "q_s", "q_t", "node", F.col("to").alias("at"), "held"]
        if hop in (1, max_length):
            state = way.select(*keys, F.col("ts").alias("last"), begun.alias("t0"))
        else:
            state = way.groupBy(*keys, *([] if relaxed else [F.col("ts").alias("last")])).agg(F.max(begun).alias("t0"), *([F.max("ts").alias("last")] if relaxed else []))
        if hop < max_length:
            state = cut(state, "frontier")
        if hop >= min_length:
            found.append(state.join(leaves, "node").select("query_id", "rule_id", F.col("at").alias("cand"), score.alias("score")))
    ended = reduce(DataFrame.unionByName, found)  # a rule ends at one depth only
    best = F.max("score") if (1 - a) * rate >= 0 else F.min("score")
    return ended.repartition("query_id").groupBy("query_id", "rule_id", "cand").agg(best.alias("score"))


def rule_walks(queries: DataFrame, rules: DataFrame, quads: DataFrame, window: int, max_length: int = 3, relaxed: bool = False) -> DataFrame:
    """(query_id, rule_id, entities, relations, times): every walk that follows a rule from a query's subject, whole.

    As ``apply_rules``, but with all entities, relations and times of each walk, so rows are walks.
    """
    steps, leaves = rule_tree(rules.select("rule_id", "head_rel", "body_rels", "var_constraints"), max_length)
    state, facts = _started(queries, rules, quads, window)
    state = state.select("*", F.array("at").alias("entities"), F.array().cast("array<int>").alias("relations"), F.array().cast("array<int>").alias("times"))
    found = []
    for hop in range(1, max_length + 1):
        way = _hop(state, steps, facts, hop, window, relaxed)
        longer = [F.concat(c, F.array(x)).alias(c) for c, x in (("entities", "to"), ("relations", "rel"), ("times", "ts"))]
        state = way.select("query_id", "q_s", "q_t", "node", F.col("to").alias("at"), "held", F.col("ts").alias("last"), *longer)
        if hop < max_length:
            state = cut(state, "walks")
        found.append(state.join(leaves, "node").select("query_id", "rule_id", "entities", "relations", "times"))
    return reduce(DataFrame.unionByName, found)


def combine(scores: DataFrame, how: str = "noisy_or") -> DataFrame:
    """(query_id, cand, score) over all rules."""
    x = F.col("score")
    made = {"noisy_or": 1 - F.product(1 - x), "sum": F.sum(x), "mean": F.avg(x), "min": F.min(x), "max": F.max(x)}[how]
    return scores.groupBy("query_id", "cand").agg(made.alias("score"))


def by_score_lists(scores: DataFrame, k: int) -> DataFrame:
    """Top k candidates a query by their descending lists of rule scores, compared item by item."""
    lists = scores.groupBy("query_id", "cand").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    order = Window.partitionBy("query_id").orderBy(F.desc("scores"), "cand")
    return lists.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def by_rule_priority(scores: DataFrame, k: int) -> DataFrame:
    """Scores of the first k + 1 rules of each query only."""
    order = Window.partitionBy("query_id").orderBy("priority")
    rules = scores.select("query_id", "rule_id", "priority").distinct().withColumn("place", F.row_number().over(order))
    return scores.join(rules.filter(F.col("place") <= k + 1).select("query_id", "rule_id"), ["query_id", "rule_id"], "left_semi")


def early_stop(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, cand, score, n_rules) after replaying the rules of a query in order of priority, stopping
    once the best k candidates have k different score lists.

    Sequential within a query only: rows are dealt by query, sorted by (query, priority), and each task
    replays its queries as one stream. A further score never lowers a candidate's list, so the best k are
    among the best k so far and the candidates of the present rule; no more are compared. What a task holds are the
    candidates of one query.
    """

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stopped, query, priority = False, None, None
        found: dict[int, list[float]] = {}  # scores, negated and ascending
        best: list[int] = []
        touched: set[int] = set()
        out: list[tuple[int, int, float, int]] = []

        def judged() -> bool:
            """The rule of this priority is over: whether the replay stops."""
            nonlocal best
            best = nsmallest(k, {*best, *touched}, key=lambda c: ([*found[c], math.inf], c))
            touched.clear()
            return len({tuple(found[c]) for c in best}) >= k

        def ended() -> None:
            out.extend((query, c, 1 - math.prod(1 + x for x in v), len(v)) for c, v in found.items())

        def given() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.int64()), strict=True)], ["query_id", "cand", "score", "n_rules"])

        for batch in batches:
            for q, p, c, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if q != query:
                    if query is not None:
                        ended()
                    query, priority, stopped, found, best = q, p, False, {}, []
                    touched.clear()
                if stopped:
                    continue
                if p != priority:
                    priority, stopped = p, judged()
                    if stopped:
                        continue
                insort(found.setdefault(c, []), -s)
                touched.add(c)
            if len(out) >= 10_000:
                yield given()
        if query is not None:
            ended()
        yield given()

    rows = scores.select(F.col("query_id").cast("long"), F.col("priority").cast("long"), F.col("cand").cast("int"), F.col("score").cast("double"))
    spread = rows.repartition("query_id").sortWithinPartitions("query_id", "priority", "cand", "score")
    return spread.mapInArrow(replay, "query_id long, cand int, score double, n_rules long")
