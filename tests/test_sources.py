"""Readers and writers on small files of every format."""

import json

from pyspark.sql import functions as F

from faultloom.functions import text, times
from faultloom.sources import readers, writers


def put(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


def test_csv_readers(spark, tmp_path):
    m = put(tmp_path, "metric.csv", "timestamp,cmdb_id,kpi_name,value\n100,a,cpu,1.5\n160,b,mem,2\n")
    assert [tuple(r) for r in readers.metric_csv(spark, m).orderBy("time").collect()] == [(100, "a", "cpu", 1.5), (160, "b", "mem", 2.0)]
    bad = put(tmp_path, "rows.csv", "time,service,metric,value\n2021-03-04T14:31:00Z,a,cpu,1\n2021-03-04T14:31:00Z,a,cpu,x\n")
    assert readers.metric_rows(spark, bad).filter(F.isnan("value")).count() == 1
    assert readers.metric_rows(spark, bad, keep_bad=False).count() == 1
    log = put(tmp_path, "log.csv", 'timestamp,cmdb_id,log_name,value\n100,a,gc,"failed, twice"\n300,a,gc,ok\n')
    row = readers.log_csv(spark, log, 0, 100).collect()
    assert [(r.time, r.level, r.message) for r in row] == [(100, "ERROR", "gc: failed, twice")]
    span = put(tmp_path, "span.csv", "timestamp,cmdb_id,parent_id,span_id,trace_id,duration\n100500,a,,s1,t1,5\n101000,b,s1,s2,t1,4\n900000,c,s1,s3,t1,4\n")
    got = {r.span_id: (r.parent_id, r.start_time) for r in readers.span_csv(spark, span, 100, 200).collect()}
    assert got == {"s1": (None, 100), "s2": ("s1", 101)}


def test_log_lines(spark, tmp_path):
    lines = ['{"ts": "1614868260", "svc": "pay", "severity": "warn", "msg": "slow"}', "2021-03-04T14:31:00 ERROR pay it broke", "no log line", '{"time": 1614868260000, "service": "db", "message": "exception here"}']
    rows = readers.log_lines(spark, put(tmp_path, "logs.jsonl", "\n".join(lines))).orderBy("raw").collect()
    assert sorted((r.time, r.service, r.level, r.message) for r in rows) == [(1614868260.0, "db", "ERROR", "exception here"), (1614868260.0, "pay", "ERROR", "it broke"), (1614868260.0, "pay", "WARN", "slow")]


def test_span_json(spark, tmp_path):
    spans = [{"traceID": "t", "spanID": "a", "processID": "p1", "operationName": "x", "startTime": 1614868260000, "duration": 5}, {"traceID": "t", "spanID": "b", "processID": "p2", "startTime": 1614868261, "duration": 1, "references": [{"refType": "OTHER", "spanID": "z"}, {"refType": "CHILD_OF", "spanID": "a"}]}]
    listed = {"data": [{"processes": [{"id": "p1", "serviceName": "pay"}, {"id": "p2", "serviceName": "db"}], "spans": spans}]}
    mapped = {"data": [{"processes": {"p1": {"serviceName": "pay"}, "p2": {"serviceName": "db"}}, "spans": spans}]}
    for k, doc in enumerate((listed, mapped)):
        rows = {r.span_id: r for r in readers.span_json(spark, put(tmp_path, f"t{k}.json", json.dumps(doc))).collect()}
        assert (rows["a"].service, rows["a"].parent_id, rows["a"].start_time) == ("pay", None, 1614868260)
        assert (rows["b"].service, rows["b"].parent_id, rows["b"].start_time) == ("db", "a", 1614868261)
    flat = readers.span_json(spark, put(tmp_path, "flat.json", json.dumps([spans[0] | {"serviceName": "web"}]))).collect()
    assert [(r.service, r.span_id) for r in flat] == [("web", "a")]


def test_small_files(spark, tmp_path):
    assert readers.json_or(spark, str(tmp_path / "none.json"), 7) == 7
    assert readers.json_or(spark, put(tmp_path, "x.json", '{"a": [1]}'), 7) == {"a": [1]}
    assert readers.text_or_empty(spark, put(tmp_path, "x.txt", "abcdef"), 3) == "abc" and readers.text_or_empty(spark, str(tmp_path / "no"), 3) == ""
    assert readers.config(spark, put(tmp_path, "c.yaml", "a: 1\n# note\nwalk:\n  rate: 0.5\n  name: 'x'\n")) == {"a": 1, "walk": {"rate": 0.5, "name": "x"}}
    assert sorted((r.id, r.name) for r in readers.name_list(spark, put(tmp_path, "n.txt", "b\na\n")).collect()) == [(0, "b"), (1, "a")]
    assert readers.quad_tsv(spark, put(tmp_path, "q.txt", "a\tr\tb\t2014-01-01\n")).count() == 1
    problem = readers.problems(spark, put(tmp_path, "p.csv", 'instruction,scoring_points\nfirst,x\n"two, lines",y\nthree,z\n'), 2)
    assert [r.instruction for r in problem.orderBy("row_no").collect()] == ["two, lines", "three"]


def test_graph_round_trips(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "service", "x<&", None, None, None, None, 60), ("b", "log_event", "x", None, "ERROR", None, 61, 60)], "id string, node_type string, service string, metric string, severity string, zscore double, event_ts long, minute_ts long")
    edges = spark.createDataFrame([("a", "b", "has_log", 1.0, None, 60)], "src string, dst string, edge_type string, weight double, dt_seconds long, minute_ts long")
    writers.graph_parquet(nodes, edges, str(tmp_path / "g"))
    n, e = readers.graph_tables(spark, str(tmp_path / "g"))
    assert sorted(map(str, n.select(*nodes.columns).collect())) == sorted(map(str, nodes.collect())) and e.count() == 1
    writers.graphml(nodes, edges, str(tmp_path / "g.graphml"))
    gn, ge = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.id: r.attrs["service"] for r in gn.collect()} == {"a": "x<&", "b": "x"}
    assert [(r.src, r.dst, r.attrs["edge_type"]) for r in ge.collect()] == [("a", "b", "has_log")]
    writers.graph_csv(nodes, edges, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv/nodes.csv"), header=True, escape='"').count() == 2


def test_times_and_rules(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    w = one(times.window_in_text(F.lit("On March 4, 2021, between 14:30 and 15:00")).alias("w"), times.window_in_text(F.lit("2021-03-04 at 14:31:15")).alias("one"), times.window_in_text(F.lit("no time")).alias("none"))
    assert (w.w.end - w.w.start, w.w.start % 86400) == (1800, 6 * 3600 + 1800) and w.one.start == w.one.end and w.none is None
    assert one(times.time_in_path(F.lit("/x/2021_03_04/14-31-00/graph.json")).alias("t")).t == 1614868260
    assert one(times.minute_bucket(F.lit(-1)).alias("t")).t == -60
    r = one(text.is_chain(F.lit("a(X0,X2,T2)<-b(X0,X1,T0)&c(X1,X2,T1)")).alias("yes"), text.is_chain(F.lit("a(X0,X2,T0)<-b(X0,X1,T0)&c(X1,X2,T1)")).alias("late"), text.is_chain(F.lit("a(X0,X2,T2)<-b(X0,X1,T0)&c(X0,X2,T1)")).alias("gap"), text.is_chain(F.lit("x")).alias("no"))
    assert tuple(r) == (True, False, False, False)
