"""Schemas of the evidence tables. Times are UTC wall-clock (``timestamp_ntz``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUESTS = (
    "request_id string, project_id string, environment string, question string, "
    "from_ts timestamp_ntz, to_ts timestamp_ntz, max_results int"
)
PROJECTS = (
    "project_id string, display_name string, environments array<string>, max_query_hours int, "
    "max_results int, logs_type string, database_type string"
)
LOG_EVENTS = (
    "project_id string, environment string, occurred_at timestamp_ntz, level string, logger string, "
    "trace_id string, message string, stack_trace string, attributes map<string,string>, arrival_seq long"
)
CHANGE_EVENTS = (
    "evidence_id string, project_id string, environment string, type string, "
    "occurred_at timestamp_ntz, attributes map<string,string>, change_seq long"
)
METRIC_ANOMALIES = (
    "evidence_id string, project_id string, environment string, metric string, description string, "
    "baseline_value double, current_value double, unit string, observed_at timestamp_ntz, metric_seq long"
)
RAW_SLOW_SQL = (
    "project_id string, environment string, sql_template string, duration_ms long, occurred_at timestamp_ntz"
)
SLOW_SQL = (
    "evidence_id string, project_id string, environment string, sql_template string, occurrences long, "
    "avg_duration_ms long, max_duration_ms long, first_seen timestamp_ntz, source string, sql_seq long"
)
DB_HEALTH = (
    "project_id string, environment string, captured_at timestamp_ntz, snapshot_id string, available boolean, "
    "unavailable_reason string, active_connections long, idle_connections long, "
    "waiting_connections long, long_transactions long, lock_waits long"
)
REQUEST_HEALTH = (
    "request_id string, project_id string, environment string, to_ts timestamp_ntz, evidence_id string, "
    "snapshot_id string, available boolean, unavailable_reason string, active_connections long, "
    "idle_connections long, waiting_connections long, long_transactions long, lock_waits long"
)
SOURCE_STATUS = (
    "project_id string, environment string, kind string, name string, state string"
)
STORED_REPORTS = (
    "diagnosis_id string, project_id string, environment string, created_at timestamp_ntz, version long, report_json string"
)
MODEL_OUTPUTS = ("request_id string, raw_json string")


def fields(ddl: str) -> dict[str, str]:
    """Column names and types of one of the schemas above."""
    return dict(part.split(" ", 1) for part in ddl.split(", "))


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project a source onto an entity: named columns in order, cast, missing ones null."""
    present = set(df.columns)
    return df.select(*[
        (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)
        for name, kind in fields(ddl).items()
    ])
