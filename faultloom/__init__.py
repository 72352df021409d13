"""faultloom: incident diagnosis over telemetry as declarative Spark plans."""
