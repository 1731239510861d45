"""Accepting or rejecting submitted requests and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlens.functions.text import not_blank


def lookup_project(df: DataFrame, projects: DataFrame, *columns: str) -> DataFrame:
    """Left join with the project table; ``_known`` and ``_env_ok`` tell what was found.

    No hint: Spark broadcasts the project table when its size, known or measured, is small.
    """
    known = projects.select(
        "project_id", F.lit(True).alias("_known"), "environments",
        *[F.col(c).alias(f"_{c}") for c in columns],
    )
    joined = df.join(known, "project_id", "left")
    return joined.withColumn(
        "_env_ok", F.coalesce(F.array_contains("environments", F.col("environment")), F.lit(False))
    ).drop("environments")


def _unregistered() -> Column:
    return F.when(F.col("_known").isNull(), "unknown-project").when(~F.col("_env_ok"), "unknown-environment")


def validate_requests(requests: DataFrame, projects: DataFrame, *limits: str) -> DataFrame:
    """Every request with ``reject_reason``; null means accepted.

    Blank fields come first, then unknown project, unknown environment, an empty or reversed
    range, and a span above the project's limit, which is exact to the instant.
    """
    blank = [F.when(~not_blank(F.col(c)), f"blank-{c}") for c in ("project_id", "environment", "question")]
    no_time = F.when(F.col("from_ts").isNull() | F.col("to_ts").isNull(), "missing-time")
    reversed_range = F.when(F.col("from_ts") >= F.col("to_ts"), "bad-range")
    allowed = F.make_dt_interval(hours=F.col("_max_query_hours"))
    too_long = F.when(F.col("to_ts") - F.col("from_ts") > allowed, "span-too-long")
    reason = F.coalesce(*blank, no_time, _unregistered(), reversed_range, too_long)
    return lookup_project(requests, projects, "max_query_hours", *limits).select(
        *requests.columns, *[f"_{name}" for name in limits], reason.alias("reject_reason"))


def accepted_requests(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Valid requests only, each with its project's row limit."""
    checked = validate_requests(requests, projects, "max_results").where(F.col("reject_reason").isNull())
    return checked.withColumn("max_results", F.col("_max_results")).select(*requests.columns)


def validate_changes(changes: DataFrame, projects: DataFrame) -> DataFrame:
    """Every posted change event with ``reject_reason``; null means it may be stored."""
    blank = [F.when(~not_blank(F.col(c)), f"blank-{c}") for c in ("project_id", "environment", "type")]
    no_time = F.when(F.col("occurred_at").isNull(), "missing-time")
    null_value = F.when(
        F.exists(F.map_values(F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>"))), F.isnull),
        "null-attribute",
    )
    reason = F.coalesce(*blank, no_time, _unregistered(), null_value)
    return lookup_project(changes, projects).select(*changes.columns, reason.alias("reject_reason"))
