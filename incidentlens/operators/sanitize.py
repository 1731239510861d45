"""Redacted copies of whole evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.functions.text import limit_stack_lines, redact, redact_map, truncate


def sanitize_logs(logs: DataFrame) -> DataFrame:
    """Message redacted and cut, stack redacted and limited, attributes redacted."""
    return logs.withColumns({
        "message": truncate(redact(F.col("message"))),
        "stack_trace": limit_stack_lines(redact(F.col("stack_trace"))),
        "attributes": redact_map(F.col("attributes")),
    })


def sanitize_changes(changes: DataFrame) -> DataFrame:
    return changes.withColumn("attributes", redact_map(F.col("attributes")))


def sanitize_slow_sql(slow_sql: DataFrame) -> DataFrame:
    return slow_sql.withColumn("sql_template", redact(F.col("sql_template")))


def sanitize_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("description", redact(F.col("description")))


def redact_questions(requests: DataFrame) -> DataFrame:
    return requests.withColumn("question", redact(F.col("question")))
