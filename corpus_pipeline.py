"""The corpus pipeline: language ID, near-dedup, decontamination, PII, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage's rows are written as
Parquet in the shared folder and read again as the next stage's docs. All but the last return the
columns of ``documents``; the last adds ``copies``, how often the mix takes a document.

A stage's tables in the shared folder are removed when the next stage begins, since its rows are written
by then; ``run`` also removes the rows of the stage before.

Defined results: a null text has no language, so the first stage drops it; null ids, sources and repeated
rows pass, each as its operator says; of near-duplicates the smallest id stays (a null id is smallest), of
equal rows one; columns beyond those of ``documents`` pass through, but ``copies`` is replaced in the last
stage; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.llm import decontaminate, language_id, mixing, pii, simhash
from faultloom.llm._common import discard, end_stages, stage_tables, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; others go."""
    with stage_tables(spark):
        return language_id.keep_known(docs, language_id.train(docs)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8) stays."""
    with stage_tables(spark):
        return simhash.keep_first(docs).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go."""
    with stage_tables(spark):
        return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pseudonymized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates."""
    with stage_tables(spark):
        made = pii.pseudonymize(docs)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return made.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: the documents taken, and how often."""
    with stage_tables(spark):
        return mixing.take(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("pii_surrogates", pseudonymized),
    ("source_mixing", mixed),
]

#: SQL can't express the first stages (a trained network, connected components).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages, one after the other, make of ``documents``."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, before = written(stage(spark, docs, sf_dir), name), docs
        if hasattr(before, "faultloom_path"):
            discard(spark, before)
    end_stages(spark)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
