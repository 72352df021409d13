"""Readers of telemetry, graphs, quadruples and small files, all with explicit schemas."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultloom import schema
from faultloom.functions.attrs import clean_attrs
from faultloom.functions.text import log_level, log_line, log_message
from faultloom.functions.times import parse_time, seconds_from_any
from faultloom.sources.shared import cut

# Keys of JSON log lines; the first that is present counts.
TIME_KEYS, SERVICE_KEYS = ("timestamp", "time", "ts", "@timestamp"), ("service", "service_name", "svc", "component")
LEVEL_KEYS, MESSAGE_KEYS = ("level", "severity", "lvl"), ("message", "msg", "log", "text")


def metric_csv(spark: SparkSession, path: str) -> DataFrame:
    """(time, service, metric, value) of a container metrics file; the whole file, as baselines need it."""
    return spark.read.schema(schema.METRIC_CSV).csv(path, header=True).select(F.col("timestamp").alias("time"), F.col("cmdb_id").alias("service"), F.col("kpi_name").alias("metric"), "value")


def metric_rows(spark: SparkSession, path: str, keep_bad: bool = True) -> DataFrame:
    """(time, service, metric, value) of a file with ISO times; a bad value is NaN, or its row goes."""
    raw = spark.read.schema("time string, service string, metric string, value string").csv(path, header=True)
    value = F.col("value").try_cast("double")
    rows = raw.select(parse_time(F.col("time")).alias("time"), "service", "metric", value.alias("value"))
    return rows.fillna(float("nan"), ["value"]) if keep_bad else rows.filter("value is not null and time is not null")


def log_csv(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """(time, service, level, message, raw) with start <= time <= end."""
    rows = spark.read.schema(schema.LOG_CSV).csv(path, header=True, multiLine=True, escape='"').filter(F.col("timestamp").between(start, end))
    message = log_message(F.col("log_name"), F.col("value"))
    return rows.select(F.col("timestamp").alias("time"), F.col("cmdb_id").alias("service"), log_level(message).alias("level"), message.alias("message"), F.to_json(F.struct("*")).alias("raw"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(time, service, level, message, raw) of JSON lines and plain lines in one file; other lines go."""
    line = F.col("value")
    m = F.from_json(line, "map<string,string>")
    rows = spark.read.text(path).select(line.alias("raw"), F.when(line.rlike(r"^\s*\{"), m).alias("m"), log_line(line).alias("p"))

    def first(keys: tuple[str, ...]):
        out = F.lit(None).cast("string")
        for k in reversed(keys):
            out = F.when(F.map_contains_key("m", k), F.element_at("m", k)).otherwise(out)
        return out

    message = F.coalesce(first(MESSAGE_KEYS), F.col("p.message"))
    level = F.coalesce(F.upper(first(LEVEL_KEYS)), F.col("p.level"), log_level(message))
    time = parse_time(F.coalesce(first(TIME_KEYS), F.col("p.time")))
    return rows.filter("m is not null or p is not null").select(time.alias("time"), F.coalesce(first(SERVICE_KEYS), F.col("p.service")).alias("service"), level.alias("level"), message.alias("message"), "raw")


def span_csv(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Spans (trace_id, span_id, parent_id, service, operation, start_time, duration); times in the file are milliseconds."""
    rows = spark.read.schema(schema.SPAN_CSV).csv(path, header=True).filter((F.col("timestamp") / 1000).between(start, end))
    parent = F.when(F.trim("parent_id") != "", F.col("parent_id"))
    return rows.select("trace_id", "span_id", parent.alias("parent_id"), F.col("cmdb_id").alias("service"), F.lit(None).cast("string").alias("operation"), F.floor(F.col("timestamp") / 1000).alias("start_time"), "duration")


def span_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The same of a trace export ``{data: [{processes, spans}]}`` or a flat list of spans; a file is one document, or
    with ``multi_line`` off has one a line, so that large files can be split.

    A span's process gives its service; its parent is the first CHILD_OF or FOLLOWS_FROM reference.
    """
    span = "struct<traceID:string,spanID:string,processID:string,operationName:string,startTime:double,duration:double,references:array<struct<refType:string,spanID:string>>,serviceName:string,parentSpanID:string>"
    fields = ", ".join(f"{n} {t}" for n, t in (("traceID", "string"), ("spanID", "string"), ("processID", "string"), ("operationName", "string"), ("startTime", "double"), ("duration", "double"), ("references", "array<struct<refType:string,spanID:string>>"), ("serviceName", "string"), ("parentSpanID", "string")))
    wide = f"data array<struct<processes:string,spans:array<{span}>>>, {fields}"
    rows = spark.read.schema(wide).json(path, multiLine=multi_line)
    nested = rows.select(F.explode("data").alias("d")).select(F.col("d.processes").alias("p"), F.explode("d.spans").alias("x"))
    listed = F.from_json("p", "array<struct<id:string,serviceName:string>>")
    by_id = F.from_json("p", "map<string,struct<serviceName:string>>")
    names = F.coalesce(F.transform_values(by_id, lambda _, v: v["serviceName"]), F.map_from_entries(F.transform(listed, lambda v: F.struct(v["id"], v["serviceName"]))))
    service = F.coalesce(F.try_element_at(names, F.col("x.processID")), F.col("x.serviceName"), F.lit("unknown"))
    flat = rows.filter("data is null and spanID is not null").select(F.struct("traceID", "spanID", "processID", "operationName", "startTime", "duration", "references", "serviceName", "parentSpanID").alias("x"), F.coalesce("serviceName", F.lit("unknown")).alias("service"))
    every = nested.select("x", service.alias("service")).unionByName(flat)
    up = F.filter("x.references", lambda r: r["refType"].isin("CHILD_OF", "FOLLOWS_FROM"))
    parent = F.coalesce(F.get(up, F.lit(0))["spanID"], F.col("x.parentSpanID"))
    return every.select(F.col("x.traceID").alias("trace_id"), F.col("x.spanID").alias("span_id"), parent.alias("parent_id"), "service", F.col("x.operationName").alias("operation"), F.floor(seconds_from_any(F.col("x.startTime"))).alias("start_time"), F.col("x.duration").cast("bigint").alias("duration"))


def problems(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(row_no, instruction, scoring_points) of rows 1 .. n of a file, or of a folder's files in order of their names: the first
    row (0) is skipped. Texts may have line ends, so a file can't be split; rows are numbered by their place in the file
    and the sizes of the files before, so only these sizes meet in one task."""
    rows = spark.read.schema(schema.PROBLEM_CSV).csv(path, header=True, multiLine=True, escape='"')
    # The ids of a file's rows follow each other, as one task reads it whole.
    rows = cut(rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id")), "problems")
    sizes = rows.groupBy("_file").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(F.broadcast(sizes.select("_file", "_first", before.alias("_before"))), "_file")
    numbered = placed.withColumn("row_no", F.col("_id") - F.col("_first") + F.col("_before")).drop("_file", "_id", "_first", "_before")
    return numbered.filter(F.col("row_no").between(1, n))


def graph_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an exported graph; a missing weight is 1."""
    nodes = spark.read.schema(schema.NODES).parquet(f"{folder}/nodes.parquet")
    edges = spark.read.schema(schema.EDGES).parquet(f"{folder}/edges.parquet")
    return nodes, edges.withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, attrs) and (src, dst, attrs) of a GraphML file; attribute names come from its keys."""
    data = "data array<struct<_key:string,_VALUE:string>>"
    keys = {r["_id"]: r["_attr.name"] for r in spark.read.schema("_id string, `_attr.name` string").format("xml").option("rowTag", "key").load(path).collect()}
    names = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv]) if keys else F.create_map().cast("map<string,string>")
    attrs = F.map_from_entries(F.transform("data", lambda d: F.struct(F.coalesce(F.try_element_at(names, d["_key"]), d["_key"]), d["_VALUE"])))
    nodes = spark.read.schema(f"_id string, {data}").format("xml").option("rowTag", "node").load(path)
    edges = spark.read.schema(f"_source string, _target string, {data}").format("xml").option("rowTag", "edge").load(path)
    return nodes.select(F.col("_id").alias("id"), attrs.alias("attrs")), edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), attrs.alias("attrs"))


def quad_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.QUAD_TSV).csv(path, sep="\t")


def triple_tsv(spark: SparkSession, path: str, sparsity: float = 1.0, seed: int = 12, exactly: int | None = None) -> DataFrame:
    """(s, r, o) names. ``sparsity`` keeps each triple with that probability, ``exactly`` that many of them, equal rows apart;
    both by hashes of the triple and the seed, so neither depends on files or partitions."""
    rows = spark.read.schema(schema.TRIPLE_TSV).csv(path, sep="\t")
    u = F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    rows = rows if sparsity >= 1 else rows.filter(u < sparsity)
    return rows if exactly is None else rows.orderBy(u, *rows.columns).limit(exactly)


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, id): lines of a file, numbered from 0 in order. One small file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("id", "name"))
    return lines.select("name", "id")


def name_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, id) of a JSON object of names to numbers."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("name", "id"))


def paths_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path_id bigint, path array<string>").json(path)


def rules_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.RULES).json(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, cand, score) of Parquet or of JSON maps ``{query: {cand: score}}``."""
    if path.endswith(".json"):
        maps = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("query_id", "m"))
        return maps.select(F.col("query_id").cast("bigint"), F.explode("m").alias("cand", "score")).withColumn("cand", F.col("cand").cast("int"))
    return spark.read.schema("query_id bigint, cand int, score double").parquet(path)


def attrs_of(rows: DataFrame, column: str = "attrs") -> DataFrame:
    return rows.withColumn(column, clean_attrs(F.col(column)))


def json_or(spark: SparkSession, path: str, default: Any) -> Any:
    """A small JSON file as Python values; the default if it is absent or empty."""
    if not exists(spark, path):
        return default
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return json.loads(text) if text.strip() else default


def text_or_empty(spark: SparkSession, path: str, limit: int) -> str:
    """The first ``limit`` characters of a small file; empty if it is absent."""
    if not exists(spark, path):
        return ""
    row = spark.read.text(path, wholetext=True).select(F.substring("value", 1, limit).alias("v")).first()
    return row["v"] if row else ""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def config(spark: SparkSession, path: str) -> dict[str, Any]:
    """A flat or two-level YAML file of ``key: value`` lines (no lists), as a dict."""
    out: dict[str, Any] = {}
    under = out
    for line in text_or_empty(spark, path, 1 << 20).splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        key, _, value = body.strip().partition(":")
        target = under if body[0] == " " else out
        if value.strip():
            target[key] = _scalar(value.strip())
        else:
            under = out[key] = {}
    return out


def _scalar(text: str) -> Any:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None}.get(text.lower(), text.strip("'\""))
