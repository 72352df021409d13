"""Queries over streams that keep anomalies and the incident graph up to date, drained to their end. name -> (query, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.plans import scalars
from faultloom.plans import telemetry as tel
from faultloom.plans.bindings import BASE_FROM, TARGET_FROM, TARGET_TO, sql
from faultloom.streaming import events, live


def edges(s: SparkSession, d: str) -> DataFrame:
    return live.appended(live.live_graph(scalars.streamed(s, d), BASE_FROM, TARGET_FROM, TARGET_TO), "live")


QUERIES: dict = {
    "str3_live_anomalies": (
        lambda s, d: edges(s, d).filter("edge_type = 'has_metric'").select("t", "service", "metric", "value", F.round("zscore", 6).alias("zscore")),
        sql("SELECT t, service, metric, value, round(zscore, 6) AS zscore FROM v_anomalies", "v_anomalies"),
    ),
    "str6_live_graph": (
        lambda s, d: edges(s, d).select("src", "dst", "edge_type", "dt_seconds", "minute_ts").distinct(),
        sql("SELECT src, dst, edge_type, dt_seconds, minute_ts FROM v_edges", "v_events", more=tel.QUIET),
    ),
    "str7_recent_anomalies": (
        lambda s, d: events.drain(live.recent_anomalies(scalars.streamed(s, d)), ["service"], "recent"),
        "SELECT service, count(*) AS n, min(t) AS oldest, max(t) AS newest, string_agg(event_id, ',' ORDER BY t, event_id) AS ids FROM (SELECT 'svc' || CAST(user_id % 20 AS VARCHAR) AS service, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id, "
        "row_number() OVER (PARTITION BY user_id % 20 ORDER BY CAST(floor(epoch(ts)) AS BIGINT) DESC, event_id DESC) AS place FROM events WHERE event_type = 'error') WHERE place <= 100 GROUP BY service",
    ),
}
