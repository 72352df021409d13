"""All registered queries of the library with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultloom.plans import causes, files, links, live, mined, scalars, stages, telemetry

_ALL = telemetry.QUERIES | links.QUERIES | causes.QUERIES | scalars.QUERIES | mined.QUERIES | live.QUERIES | files.QUERIES | stages.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _ALL.items() if text}
