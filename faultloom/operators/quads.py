"""Temporal quadruples (s, r, o, t): dictionaries, inverse edges, histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultloom.sources.shared import cut


def dictionary(df: DataFrame, *columns: str) -> DataFrame:
    """(name, id): distinct names in order, numbered from 0. Rows are names, not facts."""
    names = reduce(DataFrame.union, [df.select(F.col(c).alias("name")) for c in columns]).filter("name is not null").distinct()
    return names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("id"))


def encode(df: DataFrame, names: DataFrame, column: str, to: str) -> DataFrame:
    """A column's names replaced by ids; names that the dictionary lacks are an error at run time."""
    joined = df.join(names.select(F.col("name").alias(column), F.col("id").alias("_id")), column, "left")
    known = F.when(F.col("_id").isNull() & F.col(column).isNotNull(), F.raise_error(F.concat(F.lit("not in the dictionary: "), F.col(column)))).otherwise(F.col("_id"))
    return joined.withColumn(to, known.cast("int")).drop("_id")


def decode(df: DataFrame, names: DataFrame, column: str, to: str) -> DataFrame:
    return df.join(names.select(F.col("id").alias(column), F.col("name").alias(to)), column, "left")


def with_inverse(quads: DataFrame, n_relations: int) -> DataFrame:
    """All facts and their inverses: ends swapped, relation moved by n_relations."""
    other = F.when(F.col("r") < n_relations, F.col("r") + n_relations).otherwise(F.col("r") - n_relations).cast("int")
    return quads.unionByName(quads.select(F.col("o").alias("s"), other.alias("r"), F.col("s").alias("o"), "t"))


def background(train: DataFrame, valid: DataFrame, test: DataFrame, choice: str) -> DataFrame:
    """Union of splits by name: any of train, valid, test joined by ``+``, or all."""
    parts = {"train": train, "valid": valid, "test": test}
    names = list(parts) if choice == "all" else choice.split("+")
    return reduce(DataFrame.unionByName, [parts[n] for n in names])


def history(quads: DataFrame, at: int, window: int, learned: DataFrame | None = None) -> DataFrame:
    """Facts before ``at``, at most ``window`` back; 0: all before; -1: the learned facts."""
    if window == -1:
        return quads if learned is None else learned
    before = quads.filter(F.col("t") < at)
    return before if window == 0 else before.filter(F.col("t") >= at - window)


def pair_history(quads: DataFrame, at: int, window: int, s: int, o: int) -> DataFrame:
    """The history of one pair of ends; -1: everything."""
    return quads if window == -1 else history(quads, at, window).filter((F.col("s") == s) & (F.col("o") == o))


def query_windows(queries: DataFrame, quads: DataFrame, window: int) -> DataFrame:
    """Each query's history (t - window <= e.t < t), as (query_id, q_t, e_s, e_r, e_o, e_t).

    The range join is an equality join on time buckets as wide as the window: a query looks into two. The
    rows are the product of queries and windows, so pass ``query_times`` where only the time matters (each
    fact is then in at most ``window`` rows), and take ``near_facts`` where the query's own facts do.
    """
    return _in_window(queries.select("query_id", "t"), quads, window)


def _in_window(queries: DataFrame, facts: DataFrame, window: int, *keys: str) -> DataFrame:
    slot = F.floor(F.col("t") / window)
    q = queries.withColumn("bucket", F.explode(F.array(slot, slot - 1))).withColumnRenamed("t", "q_t")
    e = facts.select(F.col("s").alias("e_s"), F.col("r").alias("e_r"), F.col("o").alias("e_o"), F.col("t").alias("e_t"), slot.alias("bucket"))
    return q.join(e, ["bucket", *keys]).filter((F.col("e_t") < F.col("q_t")) & (F.col("e_t") >= F.col("q_t") - window)).select("query_id", "q_t", "e_s", "e_r", "e_o", "e_t")


def query_times(queries: DataFrame) -> DataFrame:
    """One query for each distinct time (query_id, t): the id is the time. These are as few as the times are."""
    return queries.select(F.col("t").cast("long").alias("query_id"), "t").distinct()


def near_facts(queries: DataFrame, quads: DataFrame, window: int, by: str = "s") -> DataFrame:
    """The part of ``query_windows`` that has the query's subject at either end (by ``s``, each fact once), or
    its relation (by ``r``), joined on that key as well as on time."""
    if by == "r":
        return _in_window(queries.select("query_id", "t", F.col("r").alias("e_r")), quads, window, "e_r")
    ends = [_in_window(queries.select("query_id", "t", F.col("s").alias(end)), quads, window, end) for end in ("e_s", "e_o")]
    return ends[0].unionByName(ends[1].filter("e_s <> e_o"))


def neighbours(quads: DataFrame) -> DataFrame:
    """Per subject: outgoing (r, o), sorted."""
    return quads.groupBy("s").agg(F.sort_array(F.collect_set(F.struct("r", "o"))).alias("out"))


def first_relation(triples: DataFrame) -> DataFrame:
    """Per (s, o): the smallest relation."""
    return triples.groupBy("s", "o").agg(F.min("r").alias("r"))


def hop_neighbourhood(quads: DataFrame, starts: DataFrame, hops: int, cap: int | None = None, seed: int = 12) -> DataFrame:
    """(id, hop): entities within ``hops`` of the starts, in either direction, at their first hop.

    With ``cap``, a hop goes on from at most that many new entities, those of the smallest hashes of seed, hop and id: the same in
    every run. Each task keeps its smallest ``cap``, and only these meet.
    """
    both = quads.select(F.col("s").alias("id"), F.col("o").alias("next")).union(quads.select("o", "s")).distinct()
    seen = level = starts.select("id").distinct().withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        level = level.join(both, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(h))
        if cap is not None:
            level = cut(level.orderBy(F.xxhash64("id", F.lit(h), F.lit(seed)), "id").limit(cap), "level")
        seen = seen.unionByName(level)
    return seen


def enclosing_subgraph(quads: DataFrame, a: int, b: int, hops: int, union: bool = False) -> DataFrame:
    """Facts whose ends are near both (or either) of two entities; the two always belong."""
    spark = quads.sparkSession
    near = [hop_neighbourhood(quads, spark.createDataFrame([(x,)], "id int"), hops).select("id") for x in (a, b)]
    nodes = near[0].union(near[1]).distinct() if union else near[0].intersect(near[1])
    nodes = nodes.union(spark.createDataFrame([(a,), (b,)], "id int")).distinct()
    for end in ("s", "o"):
        quads = quads.join(nodes.withColumnRenamed("id", end), end, "left_semi")
    return quads.select("s", "r", "o", "t")


def entities_between(quads: DataFrame, start: int, end: int, objects_only: bool = False) -> DataFrame:
    """Distinct entities of facts with start <= t < end."""
    inside = quads.filter((F.col("t") >= start) & (F.col("t") < end))
    found = inside.select(F.col("o").alias("id"))
    return (found if objects_only else found.union(inside.select("s"))).distinct()


def unseen_subjects(queries: DataFrame, quads: DataFrame) -> DataFrame:
    """Queries whose subject occurs in no fact."""
    known = quads.select("s").union(quads.select("o")).distinct()
    return queries.join(known, "s", "left_anti")
