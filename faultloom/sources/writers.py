"""Writers of graphs, rules, candidates and results. All write with Spark, in any store it knows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.operators import graph, rules


def graph_parquet(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges by minute, and the index of minutes."""
    nodes.write.mode("overwrite").partitionBy("minute_ts").parquet(f"{folder}/nodes.parquet")
    edges.write.mode("overwrite").partitionBy("minute_ts").parquet(f"{folder}/edges.parquet")
    index = graph.index(nodes, edges).withColumn("minute", F.date_format(F.timestamp_seconds("minute_ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    index.coalesce(1).write.mode("overwrite").json(f"{folder}/index.json")


def graph_csv(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges with their other columns as one JSON column."""
    n = nodes.select("id", "node_type", F.to_json(F.struct(*[c for c in nodes.columns if c not in ("id", "node_type")])).alias("attrs"))
    e = edges.select("src", "dst", "edge_type", F.to_json(F.struct(*[c for c in edges.columns if c not in ("src", "dst", "edge_type")])).alias("attrs"))
    n.write.mode("overwrite").csv(f"{folder}/nodes.csv", header=True, escape='"')
    e.write.mode("overwrite").csv(f"{folder}/edges.csv", header=True, escape='"')


def trimmed_csv(nodes: DataFrame, edges: DataFrame, folder: str, drop_nodes: tuple[str, ...], drop_edges: tuple[str, ...]) -> None:
    graph_csv(*graph.trim(nodes, edges, drop_nodes, drop_edges), folder)


def graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One GraphML document of a small slice, made of text rows in one file; nulls are empty text."""

    def escape(c):
        for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    def data(columns: Iterable[str]):
        return F.concat(*[F.concat(F.lit(f'<data key="{c}">'), escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</data>")) for c in columns])

    spark = nodes.sparkSession
    n_cols, e_cols = [c for c in nodes.columns if c != "id"], [c for c in edges.columns if c not in ("src", "dst")]
    keys = "".join(f'<key id="{c}" for="{k}" attr.name="{c}" attr.type="string"/>' for k, cols in (("node", n_cols), ("edge", e_cols)) for c in cols)
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'
    line = lambda k, text: spark.createDataFrame([(k, text)], "k int, value string")
    n = nodes.select(F.lit(1).alias("k"), F.concat(F.lit('<node id="'), escape(F.col("id")), F.lit('">'), data(n_cols), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("k"), F.concat(F.lit('<edge source="'), escape(F.col("src")), F.lit('" target="'), escape(F.col("dst")), F.lit('">'), data(e_cols), F.lit("</edge>")).alias("value"))
    every = line(0, head).union(n).union(e).union(line(3, "</graph></graphml>"))
    every.repartition(1).sortWithinPartitions("k", "value").select("value").write.mode("overwrite").text(path)


def summary_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    kinds = graph.type_counts(nodes, "node_type").withColumn("of", F.lit("nodes")).unionByName(graph.type_counts(edges, "edge_type").withColumn("of", F.lit("edges")))
    kinds.coalesce(1).write.mode("overwrite").json(path)


def paths_jsonl(paths: DataFrame, path: str) -> None:
    paths.write.mode("overwrite").json(path)


def rules_all(rows: DataFrame, names: list[str], folder: str) -> None:
    """Rules as JSON, as text by name, and as text with confidence and head."""
    rows.write.mode("overwrite").json(f"{folder}/rules.json")
    text = rules.verbalize(F.col("head_rel"), F.col("body_rels"), F.col("var_constraints"), F.array(*[F.lit(n) for n in names]), F.col("conf"), F.col("rule_supp"), F.col("body_supp"))
    texts = rows.select("head_rel", "conf", text.alias("value"))
    texts.orderBy(F.desc("conf"), "value").select("value").write.mode("overwrite").text(f"{folder}/rules.txt")
    by_head = texts.groupBy("head_rel").agg(F.sort_array(F.collect_list("value")).alias("rules"))
    by_head.write.mode("overwrite").json(f"{folder}/rules_by_head.json")


def candidates(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def result_json(row: DataFrame, path: str) -> None:
    """One-row results: evaluations, root causes."""
    row.coalesce(1).write.mode("overwrite").json(path)


def degree_statistics(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    result_json(graph.density(nodes, edges), path)
