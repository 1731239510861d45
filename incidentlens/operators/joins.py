"""Which evidence belongs to which request."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlens.session import RequestScope, instant, request_scope


def in_outer_range(evidence: DataFrame, time_col: str, scope: RequestScope) -> DataFrame:
    """Constant time bounds over all requests, so that the scan itself can skip data."""
    if scope.rows == 0:
        return evidence.where(F.lit(False))
    return evidence.where(F.col(time_col).between(instant(scope.earliest), instant(scope.latest)))


def request_evidence(
    requests: DataFrame, evidence: DataFrame, time_col: str = "occurred_at", scope: RequestScope | None = None
) -> DataFrame:
    """Evidence rows of every request: same project and environment, time inside the closed range.

    Requests are split by day and the day is part of the join key, so a row meets only requests
    that can contain it. The request side is broadcast when it was counted and found small;
    otherwise both sides shuffle on (project, environment, day) and skewed days are split at run
    time. A row with a null time belongs to no request.
    """
    scope = scope or request_scope(requests)
    days = F.broadcast(scope.days) if scope.small else scope.days
    dated = in_outer_range(evidence, time_col, scope).withColumn("_day", F.to_date(time_col))
    return (
        dated.join(days, ["project_id", "environment", "_day"])
        .where(F.col(time_col).between(F.col("from_ts"), F.col("to_ts")))
        .drop("_day")
    )


def wanted_evidence(
    requests: DataFrame, evidence: DataFrame, time_col: str = "occurred_at", scope: RequestScope | None = None
) -> DataFrame:
    """Evidence rows that at least one request asks for, each once, whatever the overlap."""
    scope = scope or request_scope(requests)
    days = scope.days.select("project_id", "environment", "_day", "from_ts", "to_ts")
    asked = F.broadcast(days) if scope.small else days
    dated = in_outer_range(evidence, time_col, scope).withColumn("_day", F.to_date(time_col))
    # by alias, so that the rows can meet the same requests again
    matches = reduce(Column.__and__, [F.col(f"e.{c}") == F.col(f"a.{c}") for c in ("project_id", "environment", "_day")])
    inside = F.col(f"e.{time_col}").between(F.col("a.from_ts"), F.col("a.to_ts"))
    return dated.alias("e").join(asked.alias("a"), matches & inside, "left_semi").drop("_day")
