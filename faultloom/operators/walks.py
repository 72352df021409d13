"""Temporal walks: bounded enumeration, features, search for causes, and random walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultloom.functions.attrs import beside
from faultloom.schema import WALK_EDGES


def _later(now: Column, before: Column) -> Column:
    """Times that may follow: negative ones are unknown and fit anywhere."""
    return (now < 0) | (before < 0) | (now >= before)


def enumerate_walks(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, hop, node, t, ways): how many walks of each length end at a node with a last edge at t.

    Walks that agree on start, end and last time have equal futures, so they are merged with a count:
    the rows are bounded by nodes and times, not by the number of walks.
    """
    step = edges.select(F.col("s").alias("node"), F.col("o").alias("next"), F.col("t").alias("at"))
    step = step.groupBy("node", "next", "at").agg(F.count(F.lit(1)).alias("n"))
    level = starts.select(F.col("id").alias("start"), F.lit(0).alias("hop"), F.col("id").alias("node"), F.lit(-1).cast("long").alias("t"), F.lit(1).cast("long").alias("ways"))
    out = level
    for hop in range(1, hops + 1):
        level = level.join(step, "node").filter(_later(F.col("at"), F.col("t")))
        level = level.groupBy("start", F.col("next").alias("node"), F.col("at").cast("long").alias("t")).agg(F.sum(F.col("ways") * F.col("n")).alias("ways"))
        level = level.select("start", F.lit(hop).alias("hop"), "node", "t", "ways")
        out = out.unionByName(level)
    return out


def walk_features(edges: DataFrame, starts: DataFrame, services: DataFrame, hops: int = 3) -> DataFrame:
    """Per start: path_count, unique_reach, last_ts_span, service_reachability, avg_path_length."""
    walks = enumerate_walks(edges, starts, hops)
    n_services = max(1, services.select("id").distinct().count())
    marked = walks.join(services.select(F.col("id").alias("node"), F.lit(True).alias("is_service")).distinct(), "node", "left")
    moved = F.when(F.col("hop") > 0, F.col("ways")).otherwise(0)
    f = marked.groupBy("start").agg(
        F.sum(moved).cast("double").alias("path_count"),
        F.countDistinct("node").cast("double").alias("unique_reach"),
        F.greatest(F.max("t"), F.lit(0)).cast("double").alias("last_ts_span"),
        (F.countDistinct(F.when(F.col("is_service"), F.col("node"))) / n_services).alias("service_reachability"),
        F.coalesce(F.sum(moved * F.col("hop")) / F.nullif(F.sum(moved), F.lit(0)), F.lit(0.0)).alias("avg_path_length"),
    )
    return f.withColumnRenamed("start", "id")


def least_steps(edges: DataFrame, starts: DataFrame, ends: DataFrame, hops: int) -> DataFrame:
    """(start, node, depth): the least number of steps, at most ``hops``, of a walk with non-decreasing times from a start to each of ``ends``.

    The earliest arrival at a node has all the futures of later ones, so a start and node are one row; the last
    step goes to the ends only, by the last time of an edge between two nodes. So no event of a hub is met that isn't an end.
    """
    step = edges.select(F.col("s").alias("node"), F.col("o").alias("next"), F.col("t").cast("long").alias("at"))
    ends = ends.select(F.col("id").alias("node")).distinct()
    to_ends = step.join(ends.withColumnRenamed("node", "next"), "next", "left_semi").groupBy("node", "next").agg(F.max("at").alias("at"), F.coalesce(F.bool_or(F.col("at") < 0), F.lit(False)).alias("any"))
    level = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(-1).cast("long").alias("t"))
    out = level.join(ends, "node", "left_semi").select("start", "node", F.lit(0).alias("depth"))
    for hop in range(1, hops + 1):
        if hop == hops:
            met = level.join(to_ends, "node").filter(F.col("any") | _later(F.col("at"), F.col("t"))).select("start", F.col("next").alias("node"))
        else:
            met = level.join(step, "node").filter(_later(F.col("at"), F.col("t")))
            level = met.groupBy("start", F.col("next").alias("node")).agg(F.min("at").alias("t"))
            met = level.join(ends, "node", "left_semi")
        out = out.unionByName(met.select("start", "node", F.lit(hop).alias("depth")))
    return out.groupBy("start", "node").agg(F.min("depth").alias("depth"))


def reach_of_services(edges: DataFrame, starts: DataFrame, services: DataFrame, calls: DataFrame, hops: int = 3) -> DataFrame:
    """Per service: starts that reach it in fewer than ``hops`` steps, their share, the mean of the least
    steps, and the services it calls."""
    n_starts = max(1, starts.select("id").distinct().count())
    walks = least_steps(edges, starts, services, hops - 1)
    per = walks.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.avg("depth").alias("depth"))
    called = calls.join(services.select(F.col("id").alias("o")).distinct(), "o", "left_semi").groupBy(F.col("s").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    joined = services.select("id").distinct().join(per, "id", "left").join(called, "id", "left")
    n = F.coalesce("n", F.lit(0)).cast("double")
    return joined.select(
        "id", n.alias("path_count"), n.alias("unique_reach"), (n / n_starts).alias("service_reachability"),
        F.coalesce("depth", F.lit(0.0)).alias("avg_path_length"), F.coalesce("c", F.lit(0)).cast("double").alias("service_connections"),
    )


def causes_back_in_time(edges: DataFrame, seeds: DataFrame, causes: DataFrame, hops: int = 3, causal_first: bool = False) -> DataFrame:
    """(seed, cause, hop, confidence): root-cause nodes met first at a hop, walking edges from their
    object to their subject at times not after the last one (0: unknown).

    Each node counts at its least hop, with its latest arrival there. Confidence is 1 / (hop + 1); with
    ``causal_first``, edges (column causal) that aren't causal cost a factor: 0.5 if the last edge isn't
    causal, 0.7 if any isn't.
    """
    step = edges.select(F.col("o").alias("node"), F.col("s").alias("prev"), F.col("t").alias("at"), (F.col("causal") if causal_first else F.lit(True)).alias("causal"))
    level = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.coalesce("t", F.lit(0)).cast("long").alias("t"), F.lit(True).alias("last"), F.lit(True).alias("all"))
    seen, out = level.select("seed", "node"), None
    for hop in range(1, hops + 1):
        level = level.join(step, "node").filter((F.col("t") == 0) | (F.col("at") <= F.col("t")))
        order = F.struct(F.col("causal").cast("int").alias("c"), (F.col("all") & F.col("causal")).cast("int").alias("a"), F.col("at").cast("long").alias("t"))
        level = level.groupBy("seed", F.col("prev").alias("node")).agg(F.max(order).alias("x"))
        level = level.select("seed", "node", F.col("x.t").alias("t"), (F.col("x.c") == 1).alias("last"), (F.col("x.a") == 1).alias("all"))
        level = level.join(seen, ["seed", "node"], "left_anti")
        factor = F.when(F.col("last"), 1.0).otherwise(0.5) * F.when(F.col("all"), 1.0).otherwise(0.7) if causal_first else F.lit(1.0)
        found = level.join(causes.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
        found = found.select("seed", F.col("node").alias("cause"), F.lit(hop).alias("hop"), (factor / (hop + 1)).alias("confidence"))
        out = found if out is None else out.unionByName(found)
        seen = seen.unionByName(level.select("seed", "node"))
    return out


def best_cause(found: DataFrame) -> DataFrame:
    """Per seed: the cause with the largest sum of confidences; ties by id."""
    total = found.groupBy("seed", "cause").agg(F.sum("confidence").alias("total"), F.count(F.lit(1)).alias("paths"))
    order = Window.partitionBy("seed").orderBy(F.desc(F.round("total", 9)), "cause")
    return total.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def cached_causes(found: DataFrame) -> DataFrame:
    return found.groupBy("seed").agg(F.max("confidence").alias("confidence"), F.sort_array(F.collect_set("cause")).alias("causes"))


def upstream(calls: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, service, hop): callers of callers, at their least hop."""
    level = seeds.select(F.col("service").alias("seed"), "service")
    seen, out = level, None
    for hop in range(1, hops + 1):
        level = level.join(calls.select(F.col("dst").alias("service"), F.col("src").alias("up")), "service").select("seed", F.col("up").alias("service")).distinct()
        level = level.join(seen, ["seed", "service"], "left_anti")
        seen = seen.unionByName(level)
        out = level.withColumn("hop", F.lit(hop)) if out is None else out.unionByName(level.withColumn("hop", F.lit(hop)))
    return out


def path_confidence(times: Column, length: Column) -> Column:
    """1 / length, halved for each step that goes back in time."""
    start = F.struct(F.lit(None).cast("long").alias("before"), F.lit(1.0).alias("c"))
    fold = F.aggregate(
        times,
        start,
        lambda acc, t: F.struct(t.cast("long").alias("before"), F.when(t < acc["before"], acc["c"] / 2).otherwise(acc["c"]).alias("c")),
        lambda acc: acc["c"],
    )
    return fold / length


def _uniform(*keys: Column) -> Column:
    """A number in (0, 1) fixed by the keys, so that a retried task draws the same."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def edge_weight(base: Column, bias: Column, gap: Column, rate: float) -> Column:
    return base * bias * F.exp(-F.lit(rate) * gap)


def type_fits(place: int, types: Column, sequence: tuple[str, ...]) -> Column:
    """A node at a place of the path has the type that the sequence asks for; beyond its end any."""
    return F.lit(True) if place >= len(sequence) else F.coalesce(types == F.lit(sequence[place]), F.lit(False))


#: Base weights of the edge types that walks take.
BASE_WEIGHTS = {"precedes": 1.0, "has_metric": 1.0, "has_log": 1.0, "calls": 0.6, "depends_on": 0.6}


def random_walks(
    edges: DataFrame, starts: DataFrame, n_walks: int = 200, max_len: int = 4, rate: float = 0.2, no_return: int = 4, seed: int = 12,
    bias: DataFrame | None = None, allowed: tuple[str, ...] = WALK_EDGES, base: dict[str, float] | None = None,
    types: tuple[str, ...] = (), monotonic: bool = True, owned: bool = False,
) -> DataFrame:
    """(start, walk, path): distinct walks of at most max_len nodes, each under the least of its numbers.

    A step has the weight base(edge type) * bias(pattern) * exp(-rate * gap), leads to a strictly later
    node (both times known; with ``monotonic`` off times don't matter), never to one of the last
    no_return nodes, and, where ``types`` has a type for a place, to a node of it.

    edges (src, dst, edge_type, src_ts, dst_ts, src_type, dst_type), as of ``rca.with_types``. Parallel
    edges of a pair add their weights. A step is drawn by the largest log(weight) - log(-log(u)), which
    picks in proportion to the weights; u is a hash of seed, walk, step and target, so that reruns agree
    whatever the partitions are. With ``owned``, ids are ``problem#id``, edges and bias have the column problem, and
    the hash takes what follows the mark.
    """
    named = (lambda c: F.substring_index(c, "#", -1)) if owned else F.col
    weights = BASE_WEIGHTS if base is None else base
    e = edges.filter(F.col("edge_type").isin(*allowed))
    if bias is not None:
        e = e.join(bias, [*(["problem"] if owned else []), "src_type", "edge_type", "dst_type"], "left")
    of_type = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("edge_type")), F.lit(1.0)) if weights else F.lit(1.0)
    weight = of_type * (F.coalesce("bias", F.lit(1.0)) if bias is not None else F.lit(1.0))
    to_type = F.col("dst_type") if "dst_type" in edges.columns else F.lit(None).cast("string")
    e = e.select(F.col("src").alias("at"), F.col("dst").alias("to"), "src_ts", "dst_ts", to_type.alias("to_type"), weight.alias("w"))
    if monotonic:
        e = e.filter(F.col("dst_ts") > F.col("src_ts"))
    # Exact sums, so that the order in which rows meet can't show.
    total = F.sum(F.col("w").cast("decimal(30,12)")).cast("double")
    e = e.groupBy("at", "to").agg(F.min("src_ts").alias("src_ts"), F.min("dst_ts").alias("dst_ts"), F.min("to_type").alias("to_type"), total.alias("w"))
    gap = (F.col("dst_ts") - F.col("src_ts")).cast("double") if monotonic else F.lit(0.0)
    e = e.select("at", "to", "to_type", F.log(edge_weight(F.col("w"), F.lit(1.0), gap, 0.0)).alias("log_w"), (F.lit(rate) * gap).alias("decay")).filter("log_w is not null")
    walks = starts.select(F.col("id").alias("start")).distinct().select("start", F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1))).alias("walk"))
    walks = walks.select("start", "walk", F.array("start").alias("path"))
    if types:
        own = edges.select(F.col("src").alias("start"), F.col("src_type").alias("own_type")).distinct()
        walks = walks.join(own.filter(type_fits(0, F.col("own_type"), types)), "start", "left_semi")
    for hop in range(max_len - 1):
        can = walks.filter(F.size("path") == hop + 1).withColumn("at", F.element_at("path", -1)).join(e, "at")  # others have ended
        can = can.filter(~F.array_contains(F.slice("path", F.greatest(F.size("path") - no_return + 1, F.lit(1)), no_return), F.col("to")))
        can = can.filter(type_fits(hop + 1, F.col("to_type"), types))
        u = _uniform(F.lit(seed), named("start"), F.col("walk"), F.lit(hop), named("to"))
        draw = F.struct((F.col("log_w") - F.col("decay") - F.log(-F.log(u))).alias("draw"), "to")
        chosen = can.groupBy("start", "walk").agg(F.max_by("to", draw).alias("to"))
        walks = walks.join(chosen, ["start", "walk"], "left").select(
            "start", "walk", F.when(F.col("to").isNull(), F.col("path")).otherwise(F.concat("path", F.array("to"))).alias("path")
        )
    return walks.filter(F.size("path") > 1).groupBy("start", "path").agg(F.min("walk").alias("walk")).select("start", "walk", "path")


def _steps(w: DataFrame, step: DataFrame, n_relations: int, hop: int, length: int, relaxed: bool) -> DataFrame:
    """Walks (entities, relations, times, ...) with every step (rel, to, ts) that may follow."""
    w = w.withColumn("at", F.element_at("entities", -1)).withColumn("now", F.element_at("times", -1))
    bound = F.get("times", F.lit(0)) if relaxed else F.col("now")
    w = w.join(step, "at").filter((F.col("ts") < bound) if hop == 1 else (F.col("ts") <= bound))
    back = F.element_at("relations", -1)
    inverse = F.when(back < n_relations, back + n_relations).otherwise(back - n_relations)
    undone = (F.col("rel") == inverse) & (F.col("ts") == F.col("now")) & (F.col("to") == F.element_at("entities", -2))
    w = w.filter(~undone) if hop > 1 else w
    return w.filter(F.col("to") == F.get("entities", F.lit(0))) if hop == length else w


def _moved(w: DataFrame, *keys: str) -> DataFrame:
    return w.select(*keys, F.concat("entities", F.array("to")).alias("entities"), F.concat("relations", F.array("rel")).alias("relations"), F.concat("times", F.array("ts")).alias("times"))


def _quad_steps(quads: DataFrame) -> DataFrame:
    return quads.select(F.col("s").alias("at"), F.col("r").alias("rel"), F.col("o").alias("to"), F.col("t").alias("ts"))


def cyclic_walks(quads: DataFrame, n_relations: int, length: int, max_gap: int, relaxed: bool = False) -> DataFrame:
    """(entities, relations, times) of all cyclic walks: hop 1 strictly back in time, then not later, no
    step undone by its exact inverse, the last hop back at the start; with ``relaxed``, times are bounded
    by the first one only. All walks, not a sample."""
    w = quads.select(F.array("s", "o").alias("entities"), F.array("r").alias("relations"), F.array("t").alias("times"))
    for hop in range(1, length + 1):
        w = _steps(w, _quad_steps(quads), n_relations, hop, length, relaxed)
        w = _moved(w.filter(F.abs(F.col("now") - F.col("ts")) <= max_gap))
    return w


def start_facts(quads: DataFrame, n_walks: int, seed: int = 12, parts: int = 256) -> DataFrame:
    """(r, walk, s, o, t): n_walks facts of each relation, drawn uniformly with repetition.

    Facts of a relation are numbered in ``parts`` parts by their hash, so no task holds a relation.
    """
    part = F.pmod(F.xxhash64("s", "r", "o", "t"), F.lit(parts)).cast("int").alias("part")
    facts = quads.select("s", "r", "o", "t", part)
    sizes = facts.groupBy("r", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("r")))
    draws = sizes.select("r", "all").distinct().select("r", "all", F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1))).alias("walk"))
    draws = draws.select("r", "walk", F.floor(_uniform(F.lit(seed), F.lit("start"), F.col("r"), F.col("walk")) * F.col("all")).alias("k"))
    drawn = draws.join(sizes, "r").filter((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("n")))
    drawn = drawn.select("r", "part", "walk", (F.col("k") - F.col("before") + 1).cast("int").alias("place"))
    order = Window.partitionBy("r", "part").orderBy("s", "o", "t")
    return facts.withColumn("place", F.row_number().over(order)).join(drawn, ["r", "part", "place"]).select("r", "walk", "s", "o", "t")


def sample_cyclic_walks(
    quads: DataFrame, n_relations: int, length: int, n_walks: int = 200, transition: str = "exp", relaxed: bool = False, seed: int = 12
) -> DataFrame:
    """(r, walk, entities, relations, times): cyclic walks drawn step by step, n_walks tries for each
    relation; tries that end before they close are gone.

    A step is drawn in proportion to exp(ts - now), or uniformly (``unif``, and where all weights are
    zero in a double). Rules of time and of inverse steps as in ``cyclic_walks``.
    """
    if transition not in ("exp", "unif"):
        raise ValueError(f"transition {transition!r} is neither exp nor unif")
    w = start_facts(quads, n_walks, seed).select("r", "walk", F.array("s", "o").alias("entities"), F.array("r").alias("relations"), F.array("t").alias("times"))
    least = -745.0  # Fixed value: exp of less is zero in a double.
    for hop in range(1, length + 1):
        can = _steps(w, _quad_steps(quads), n_relations, hop, length, relaxed)
        gap = (F.col("ts") - F.col("now")).cast("double")
        gumbel = -F.log(-F.log(_uniform(F.lit(seed), F.lit(length), F.col("r"), F.col("walk"), F.lit(hop), F.col("rel"), F.col("to"), F.col("ts"))))
        one = F.struct("rel", "to", "ts")
        pick = lambda score: F.max_by(one, F.struct(score.alias("draw"), one.alias("edge")))
        chosen = can.groupBy("r", "walk").agg(pick(gap + gumbel).alias("by_time"), pick(gumbel).alias("any"), F.max(gap).alias("gap"))
        use = F.col("any") if transition == "unif" else F.when(F.col("gap") < least, F.col("any")).otherwise(F.col("by_time"))
        w = _moved(w.join(chosen.select("r", "walk", use.alias("x")), ["r", "walk"]).select("*", "x.*"), "r", "walk")
    return w


def learned_by_sampling(quads: DataFrame, n_relations: int, lengths: tuple[int, ...] = (1, 2, 3), n_walks: int = 200, transition: str = "exp", relaxed: bool = False, seed: int = 12) -> DataFrame:
    """Sampled cyclic walks of rules of each length, for every relation: column ``length`` is the body's."""
    made = [sample_cyclic_walks(quads, n_relations, n, n_walks, transition, relaxed, seed).withColumn("length", F.lit(n)) for n in lengths]
    return reduce(DataFrame.unionByName, made)


def sample_start(quads: DataFrame, per_relation: int, seed: int = 12) -> DataFrame:
    """Facts drawn uniformly, ``per_relation`` for each relation."""
    w = Window.partitionBy("r").orderBy(_uniform(F.lit(seed), F.col("s"), F.col("r"), F.col("o"), F.col("t")), "s", "o", "t")
    return quads.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_relation).drop("place")


def sample_by_time(quads: DataFrame, seed: int = 12) -> DataFrame:
    """Facts kept with a probability that grows linearly from the first to the last time."""
    ends = quads.groupBy().agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    p = F.when(F.col("hi") > F.col("lo"), (F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return beside(quads, ends).filter(_uniform(F.lit(seed), F.col("s"), F.col("r"), F.col("o"), F.col("t")) <= p).drop("lo", "hi")


def seed_events(nodes: DataFrame, kind: str = "metric") -> DataFrame:
    """One event a service to start from: a metric event with abs(zscore) > 2, or a log event at ERROR;
    the largest abs(zscore), ties by id."""
    if kind == "metric":
        found = nodes.filter((F.col("node_type") == "metric_event") & (F.abs("zscore") > 2))
    else:
        found = nodes.filter((F.col("node_type") == "log_event") & (F.col("severity") == "ERROR"))
    rest = [c for c in nodes.columns if c != "service"]
    largest = F.struct((-F.coalesce(F.round(F.abs("zscore"), 9), F.lit(-1.0))).alias("z"), "id")
    return found.groupBy("service").agg(F.min_by(F.struct(*rest), largest).alias("x")).select("service", "x.*").select(*nodes.columns)


def seed_event(nodes: DataFrame, service: str, kind: str = "metric") -> DataFrame:
    """The event of one service to start from."""
    return seed_events(nodes.filter(F.col("service") == service), kind)


def is_root_cause(node_type: str = "node_type", zscore: str = "zscore") -> Column:
    """A service, or a metric event with abs(zscore) > 2."""
    return (F.col(node_type) == "service") | ((F.col(node_type) == "metric_event") & F.coalesce(F.abs(F.col(zscore)) > 2, F.lit(False)))


def first_events(nodes: DataFrame) -> DataFrame:
    """(service, id): the first event of each service by time, then id."""
    events = nodes.filter("node_type <> 'service'")
    return events.groupBy("service").agg(F.min_by("id", F.struct("event_ts", "id")).alias("id"))


def causal_part(edges: DataFrame, kinds: tuple[str, ...] = ("causes",)) -> DataFrame:
    return edges.filter(F.col("edge_type").isin(*kinds))


def path_services(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path_id, services, share, confidence): service nodes of each path in order; their share of the
    path; 1 / (steps + 1) times the share."""
    kind = nodes.groupBy("id").agg(F.min("node_type").alias("node_type"))
    v = paths.select("path_id", F.posexplode("path").alias("step", "id")).join(kind, "id", "left")
    s = v.groupBy("path_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("node_type") == "service", F.struct("step", "id")))).alias("x"), F.count(F.lit(1)).alias("n")
    )
    share = F.size("x") / F.col("n")
    return s.select("path_id", F.transform("x", lambda v: v["id"]).alias("services"), share.alias("share"), (share / F.col("n")).alias("confidence"))


def sample_anchors(quads: DataFrame, n: int, seed: int = 12) -> DataFrame:
    """n facts, drawn by a hash of the fact and the seed."""
    return quads.orderBy(_uniform(F.lit(seed), F.col("s"), F.col("r"), F.col("o"), F.col("t")), "s", "r", "o", "t").limit(n)


def walk_text(entities: Column, relations: Column, times: Column) -> Column:
    """entity, relation, time and entity of each step, tab by tab."""
    steps = F.transform(relations, lambda r, i: F.concat_ws("\t", F.get(entities, i).cast("string"), r.cast("string"), F.get(entities, i + 1).cast("string"), F.get(times, i).cast("string")))
    return F.array_join(steps, "\t")
