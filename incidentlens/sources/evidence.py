"""Metrics, slow SQL, change events and the union of several sources of one kind."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens import schemas
from incidentlens.operators.joins import request_evidence
from incidentlens.operators.ranking import top_n

ENTITY_SCHEMAS = {
    "log": schemas.LOG_EVENTS, "metric": schemas.METRIC_ANOMALIES, "slow-sql": schemas.SLOW_SQL,
    "change-event": schemas.CHANGE_EVENTS, "db-health": schemas.DB_HEALTH,
}
#: An evidence source: called with the session and the requests, it returns rows of its kind.
Source = Callable[[SparkSession, DataFrame], DataFrame]


class SourceRegistry:
    """The evidence sources of every kind, in the order their rows are concatenated."""

    def __init__(self) -> None:
        self._sources: dict[str, list[tuple[str, Source]]] = {kind: [] for kind in ENTITY_SCHEMAS}

    def register(self, kind: str, name: str, source: Source) -> None:
        if kind not in self._sources:
            raise ValueError(f"unknown evidence kind {kind!r}")
        self._sources[kind].append((name, source))

    def collect(self, spark: SparkSession, requests: DataFrame, kind: str) -> tuple[DataFrame, list[str]]:
        """Rows of all sources of a kind, and a label for each source that could not be opened.

        Rows keep the order of the sources in ``source_ord`` and duplicates stay.
        """
        schema, opened, failed = ENTITY_SCHEMAS[kind], [], []
        for position, (name, source) in enumerate(self._sources[kind]):
            try:
                rows = checked(source(spark, requests), schema, name)
            except Exception:  # any failing source degrades to no rows and a label
                failed.append(f"{kind}:{name} (error)")
                continue
            opened.append(rows.withColumn("source_ord", F.lit(position)))
        empty = spark.createDataFrame([], schema).withColumn("source_ord", F.lit(0))
        return reduce(DataFrame.unionByName, opened, empty), failed


def checked(df: DataFrame, schema: str, name: str) -> DataFrame:
    """A source must deliver every column of its entity; extra columns are dropped."""
    missing = [name for name in schemas.fields(schema) if name not in df.columns]
    if missing:
        raise ValueError(f"source {name} lacks the columns {missing}")
    return schemas.conform(df, schema)


# --- metrics, slow SQL, changes -----------------------------------------------------------------

def metrics_in_range(requests: DataFrame, metrics: DataFrame, n: int | None = None) -> DataFrame:
    rows = request_evidence(requests, metrics, "observed_at")
    return rows if n is None else top_n(rows, ["request_id"], [F.col("metric_seq"), F.col("evidence_id")], n)


def slow_sql_in_range(requests: DataFrame, slow_sql: DataFrame, n: int | None = None) -> DataFrame:
    rows = request_evidence(requests, slow_sql, "first_seen")
    return rows if n is None else top_n(rows, ["request_id"], [F.col("sql_seq"), F.col("evidence_id"), F.col("first_seen")], n)


def changes_in_range(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """Uncapped change events per request; a null time belongs to none."""
    return request_evidence(requests, changes)


def recent_changes(requests: DataFrame, changes: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` change events per request, numbered oldest first."""
    newest = top_n(request_evidence(requests, changes), ["request_id"],
                   [F.desc("occurred_at"), F.desc("change_seq")], n, "newest_no")
    oldest_first = [F.col("occurred_at"), F.col("change_seq")]
    return top_n(newest, ["request_id"], oldest_first, n, "place")


def rollup_slow_sql(raw: DataFrame, *scope: str) -> DataFrame:
    """Statements per template: occurrences, average, maximum, first seen.

    ``scope`` are more grouping columns, such as the request. The average is rounded half up in
    whole numbers, so it does not depend on the order of additions.
    """
    keys = [*scope, "project_id", "environment", "sql_template"]
    return raw.groupBy(*keys).agg(
        F.count("*").alias("occurrences"), F.sum("duration_ms").alias("_total"),
        F.max("duration_ms").alias("max_duration_ms"), F.min("occurred_at").alias("first_seen"),
    ).select(
        F.concat(F.lit("sql-"), F.substring(F.md5(F.col("sql_template").cast("binary")), 1, 12)).alias("evidence_id"),
        *keys, "occurrences",
        F.expr("CAST((2 * _total + occurrences) DIV (2 * occurrences) AS BIGINT)").alias("avg_duration_ms"),
        "max_duration_ms", "first_seen", F.lit("log").alias("source"), F.lit(0).cast("long").alias("sql_seq"),
    )


# --- degradation --------------------------------------------------------------------------------

def source_labels(status: DataFrame) -> DataFrame:
    """``kind:Name (state)`` for every source that did not answer."""
    return status.where(F.col("state") != "ok").select(
        "project_id", "environment",
        F.concat("kind", F.lit(":"), "name", F.lit(" ("), "state", F.lit(")")).alias("label"),
    ).distinct()


def unavailable_sources(requests: DataFrame, status: DataFrame) -> DataFrame:
    """Sorted labels of unavailable sources per request; as many as there are configured sources."""
    return requests.join(source_labels(status), ["project_id", "environment"]).groupBy("request_id").agg(
        F.array_sort(F.collect_list("label")).alias("unavailable_sources"))
