"""Evidence budget: which rows of every kind are kept, and how many were cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens.operators.ranking import top_n

KINDS = ("log_clusters", "slow_sql", "metrics", "change_events")


def keep_clusters(clusters: DataFrame, cap: int = C.BUDGET_CLUSTERS) -> DataFrame:
    return top_n(clusters, ["request_id"], [F.desc("spike"), F.desc("count"), F.col("cluster_seq")], cap)


def keep_slow_sql(slow_sql: DataFrame, cap: int = C.BUDGET_SLOW_SQL) -> DataFrame:
    order = [F.desc("avg_duration_ms"), F.col("sql_seq"), F.col("evidence_id")]
    return top_n(slow_sql, ["request_id"], order, cap)


def keep_metrics(metrics: DataFrame, cap: int = C.BUDGET_METRICS) -> DataFrame:
    return top_n(metrics, ["request_id"], [F.col("metric_seq"), F.col("evidence_id")], cap)


def keep_changes(changes: DataFrame, cap: int = C.BUDGET_CHANGES) -> DataFrame:
    return top_n(changes, ["request_id"], [F.col("change_seq"), F.col("evidence_id")], cap)


def budget_report(requests: DataFrame, clusters: DataFrame, slow_sql: DataFrame, metrics: DataFrame,
                  changes: DataFrame, caps: tuple[int, int, int, int] = (
                      C.BUDGET_CLUSTERS, C.BUDGET_SLOW_SQL, C.BUDGET_METRICS, C.BUDGET_CHANGES)) -> DataFrame:
    """Kept and truncated rows per kind for every request, from counts alone."""
    marks = [
        df.groupBy("request_id").agg(F.count("*").alias("rows")).withColumn("kind", F.lit(kind))
        for kind, df in zip(KINDS, (clusters, slow_sql, metrics, changes))
    ]
    asked = requests.select("request_id", F.lit(0).cast("long").alias("rows"), F.lit("").alias("kind"))
    counted = reduce(DataFrame.unionByName, [asked, *marks])
    totals = counted.groupBy("request_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rows"))), F.lit(0)).alias(kind) for kind in KINDS
    ])
    columns = []
    for kind, cap in zip(KINDS, caps):
        kept = F.least(F.col(kind), F.lit(cap).cast("long"))
        columns += [kept.alias(f"{kind}_kept"), (F.col(kind) - kept).alias(f"{kind}_truncated")]
    report = totals.select("request_id", *columns)
    cut = reduce(lambda a, b: a | b, [F.col(f"{kind}_truncated") > 0 for kind in KINDS])
    return report.withColumn("any_truncated", cut)
