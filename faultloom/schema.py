"""Schemas and vocabulary: one spelling of node and edge types from ingestion on."""

from __future__ import annotations

# Columns of exported graphs and the edge types that walks may take.
NODE_COLUMNS = ("id", "node_type", "service", "metric", "severity", "zscore", "event_ts", "minute_ts")
EDGE_COLUMNS = ("src", "dst", "edge_type", "weight", "dt_seconds", "minute_ts")
ALLOWED_EDGES = ("calls", "depends_on", "has_metric", "has_log", "precedes", "persists_to", "evolves_to")
WALK_EDGES = ("precedes", "has_log", "has_metric", "calls", "depends_on")

METRIC_CSV = "timestamp bigint, cmdb_id string, kpi_name string, value double"
LOG_CSV = "timestamp bigint, cmdb_id string, log_name string, value string"
SPAN_CSV = "timestamp bigint, cmdb_id string, parent_id string, span_id string, trace_id string, duration bigint"
QUAD_TSV = "subject string, relation string, object string, timestamp string"
TRIPLE_TSV = "subject string, relation string, object string"
PROBLEM_CSV = "instruction string, scoring_points string"

NODES = "id string, node_type string, service string, metric string, severity string, zscore double, event_ts bigint, minute_ts bigint"
EDGES = "src string, dst string, edge_type string, weight double, dt_seconds bigint, minute_ts bigint"
QUADS = "s int, r int, o int, t int"
RULES = "head_rel int, body_rels array<int>, var_constraints array<array<int>>, conf double, rule_supp bigint, body_supp bigint, llm_confidence double"
