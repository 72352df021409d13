"""Anomalies and the incident graph kept up to date on a stream, recent anomalies and cached walks.

Events are held for as long as earlier ones may still come (the watermark) and then taken in the order of their time, so
what comes out doesn't depend on how the stream is cut into batches: after the last batch it is what the batch
queries make of the same rows. Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from faultloom.operators.anomaly import MIN_BASELINE_ROWS
from faultloom.sources.shared import shared_folder
from faultloom.streaming.events import LATE, latest, run

LIVE = "minute_ts long, src string, dst string, edge_type string, dt_seconds long, t long, service string, metric string, value double, zscore double"


def merged(a: list[float], b: list[float]) -> list[float]:
    """Moments (n, mean, sum of squared deviations) of two sets of values taken together."""
    n = a[0] + b[0]
    if not n:
        return [0, 0.0, 0.0]
    gap = b[1] - a[1]
    return [n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n]


def moments(values: np.ndarray) -> list[float]:
    return [len(values), float(values.mean()), float(((values - values.mean()) ** 2).sum())] if len(values) else [0, 0.0, 0.0]


class _Service:
    """A service's state: moments of its series' baselines, events that wait for the watermark, its last event of the graph."""

    def __init__(self, text: str | None):
        self.base, self.held, self.last = json.loads(text) if text else ({}, [], None)

    def text(self) -> str:
        return json.dumps([self.base, self.held, self.last])

    def taken(self, name: str, before: int | None, window: tuple[int, int, int], threshold: float) -> list[tuple]:
        """What the held events earlier than ``before`` (all if None) make, in order."""
        base_from, start, end = window
        ready = sorted(x for x in self.held if before is None or x[0] < before)
        self.held = [x for x in self.held if before is not None and x[0] >= before]
        fit = lambda v: v is not None and math.isfinite(v)
        values: dict[str, list[float]] = {}
        for t, _, kind, value in ready:
            if base_from <= t < start and fit(value):
                values.setdefault(kind, []).append(value)
        for kind, v in values.items():
            self.base[kind] = merged(self.base.get(kind, [0, 0.0, 0.0]), moments(np.array(v)))
        found = []
        for t, seq, kind, value in ready:
            if not start <= t <= end:
                continue
            if kind == "error":
                found.append((t, 0, seq, f"log:{name}:{seq}", None, None, None))
            n, mean, squares = self.base.get(kind, [0, 0.0, 0.0])
            if fit(value) and n >= MIN_BASELINE_ROWS:
                z = (value - mean) / (math.sqrt(squares / n) or 1.0)
                if abs(z) >= threshold:
                    found.append((t, 1, t, f"met:{name}:{kind}:{t}", kind, value, z))
        out = []
        for t, rank, seq, node, kind, value, z in sorted(found, key=lambda x: x[:4]):
            minute = t - t % 60
            out.append((minute, f"svc:{name}", node, "has_log" if rank == 0 else "has_metric", None, t, name, kind, value, z))
            if self.last and self.last[1] - self.last[1] % 60 == minute:
                out.append((minute, self.last[0], node, "precedes", t - self.last[1], t, name, None, None, None))
            self.last = [node, t]
        return out


def live_graph(events: DataFrame, base_from: int, start: int, end: int, threshold: float = 3.0, late: str = LATE) -> DataFrame:
    """Edges of the incident graph as their later ends arrive: has_log, has_metric (with value and zscore against the
    baseline [base_from, start) of the series) and precedes, for events with start <= t <= end.

    State of a service: moments of each of its series, its last event, and the events of the time that may still change.
    """
    window = (base_from, start, end)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        service = _Service(state.get[0] if state.exists else None)
        for rows in batches:
            inside = rows[(rows["t"] >= base_from) & (rows["t"] <= end)]
            values = inside["value"].astype(object).where(inside["value"].notna(), None)
            service.held += [list(x) for x in zip(inside["t"].tolist(), inside["event_id"].tolist(), inside["type"].tolist(), values.tolist(), strict=True)]
        past = state.getCurrentWatermarkMs()
        made = service.taken(key[0], past // 1000, window, threshold)  # whole seconds that lie before the watermark
        state.update((service.text(),))
        if service.held:
            state.setTimeoutTimestamp(max(past + 1, (min(service.held)[0] + 1) * 1000))
        frame = pd.DataFrame(made, columns=[c.split()[0] for c in LIVE.split(", ")])
        for c in ("minute_ts", "dt_seconds", "t"):
            frame[c] = frame[c].astype("Int64")
        for c in ("value", "zscore"):
            frame[c] = frame[c].astype("float64")
        yield frame

    marked = events.withWatermark("ts", late).select("event_id", "ts", "t", "service", "type", "value")
    return marked.groupBy("service").applyInPandasWithState(follow, LIVE, "state string", "append", "EventTimeTimeout")


def recent_anomalies(events: DataFrame, keep: int = 100, expire: int | None = None, late: str = LATE) -> DataFrame:
    """(service, n, oldest, newest, ids): after each batch with news, the last ``keep`` errors of a service by time and id;
    those that lie more than ``expire`` seconds before the watermark go, and with the last of them the state."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        for rows in batches:
            wrong = rows[rows["type"] == "error"]
            held = sorted([*held, *map(list, zip(wrong["t"].tolist(), wrong["event_id"].tolist(), strict=True))])[-keep:]
        past = state.getCurrentWatermarkMs()
        if expire is not None:
            held = [x for x in held if x[0] * 1000 >= past - expire * 1000]
        if held:
            state.update((json.dumps(held),))
            if expire is not None:
                state.setTimeoutTimestamp(max(past + 1, (held[0][0] + expire) * 1000 + 1))
        elif state.exists:
            state.remove()
        else:
            return
        yield pd.DataFrame(
            {"service": [key[0]], "n": [len(held)], "oldest": pd.array([held[0][0] if held else None], "Int64"), "newest": pd.array([held[-1][0] if held else None], "Int64"), "ids": [",".join(str(i) for _, i in held)]}
        )

    marked = events.withWatermark("ts", late).select("event_id", "ts", "t", "service", "type")
    return marked.groupBy("service").applyInPandasWithState(follow, "service string, n long, oldest long, newest long, ids string", "state string", "update", "EventTimeTimeout")


def cache_walks(anomalies: DataFrame, find: Callable[[DataFrame], DataFrame], path: str, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """For each batch of anomalies (service, t, id ...), the walks that ``find`` gives for the newest one of each service: rows (service, ...),
    which replace the service's earlier ones. Read with ``cached_walks``. A batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != "service"]
        newest = batch.groupBy("service").agg(F.max_by(F.struct(*rest), F.struct("t", "id")).alias("x")).select("service", "x.*")
        find(newest).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run(anomalies, write, name, "append", checkpoint)


def cached_walks(spark: SparkSession, path: str) -> DataFrame:
    """All rows of each service's last batch of ``cache_walks``."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    return rows.join(rows.groupBy("service").agg(F.max("batch").alias("batch")), ["service", "batch"]).drop("batch")


def appended(stream: DataFrame, name: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Runs an appending stream over all that is there and gives all rows that it has made."""
    spark = stream.sparkSession
    path = path or f"{shared_folder(spark)}/faultloom-sink-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run(stream, write, name, "append", checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


__all__ = ["appended", "cache_walks", "cached_walks", "latest", "live_graph", "merged", "moments", "recent_anomalies"]
