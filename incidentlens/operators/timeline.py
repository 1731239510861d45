"""Evidence rows and timeline entries of all kinds, brought to one form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentlens.functions import rules as R
from incidentlens.operators.ranking import number_rows

#: The order of timeline entries: time, then kind, then the order inside the kind.
TIMELINE_ORDER = ["at", "category_ord", "weight", "seq", "evidence_id"]


def _order() -> list[Column]:
    return [F.col("at").asc_nulls_last(), *[F.col(c).asc() for c in TIMELINE_ORDER[1:]]]


def _entry(df: DataFrame, at: str, category: str, ordinal: int, text: Column,
           weight: Column | None = None, seq: str | None = None) -> DataFrame:
    return df.select(
        "request_id", F.col(at).alias("at"), F.lit(category).alias("category"), text.alias("description"),
        "evidence_id", F.lit(ordinal).alias("category_ord"),
        (weight if weight is not None else F.lit(0)).cast("long").alias("weight"),
        (F.col(seq) if seq else F.lit(0)).cast("long").alias("seq"),
    )


def timeline_entries(changes: DataFrame, clusters: DataFrame, metrics: DataFrame, slow_sql: DataFrame,
                     health: DataFrame | None = None) -> DataFrame:
    """One entry per evidence row; a database snapshot stands at the end of the range."""
    kinds = [
        _entry(changes, "occurred_at", "CHANGE", 1, F.col("type"), seq="change_seq"),
        _entry(clusters, "first_seen", "LOG", 2, R.cluster_timeline_text(), weight=-F.col("count"), seq="cluster_seq"),
        _entry(metrics, "observed_at", "METRIC", 3, F.col("description"), seq="metric_seq"),
        _entry(slow_sql, "first_seen", "SLOW_SQL", 4, R.slow_sql_timeline_text(), seq="sql_seq"),
    ]
    if health is not None:
        kinds.append(_entry(health.where("available"), "to_ts", "DB_HEALTH", 5, R.health_text()))
    return reduce(DataFrame.unionByName, kinds)


def order_timeline(entries: DataFrame) -> DataFrame:
    """Number the entries of every request; a request may have any number of them."""
    return number_rows(entries, ["request_id"], _order(), "position")


def order_short_timeline(entries: DataFrame) -> DataFrame:
    """The same for entries that went through the budget: a few dozen per request."""
    by_request = Window.partitionBy("request_id").orderBy(*_order())
    return entries.withColumn("position", F.row_number().over(by_request))


def evidence_rows(clusters: DataFrame, metrics: DataFrame, slow_sql: DataFrame, changes: DataFrame,
                  health: DataFrame | None = None) -> DataFrame:
    """Budgeted evidence as ``(request_id, evidence_id, type, description)`` in report order."""
    def rows(df: DataFrame, kind: str, ordinal: int, text: Column, rank: Column = F.col("rank_no")) -> DataFrame:
        return df.select(
            "request_id", "evidence_id", F.lit(kind).alias("type"), text.alias("description"),
            F.lit(ordinal).alias("type_ord"), rank.cast("long").alias("rank_no"),
        )

    kinds = [
        rows(clusters, "LOG_CLUSTER", 1, R.cluster_evidence_text()),
        rows(metrics, "METRIC", 2, F.col("description")),
        rows(slow_sql, "SLOW_SQL", 3, R.slow_sql_evidence_text()),
        rows(changes, "CHANGE_EVENT", 4, R.change_evidence_text()),
    ]
    if health is not None:
        kinds.append(rows(health.where("available"), "DB_HEALTH", 5, R.health_text(), F.lit(1)))
    return reduce(DataFrame.unionByName, kinds)
