"""Column expressions of the rules and of the texts that describe evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens.functions.text import render_map


def evidence_strength(sources: Column, shared_trace: Column, rule_hit: Column) -> Column:
    backed = sources >= 2
    return F.when(backed & (shared_trace | rule_hit), "STRONG").when(backed, "MODERATE").otherwise("WEAK")


def _contains_any(text: Column, *words: str) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(F.lower(text), F.lit(word))
    return F.coalesce(found, F.lit(False))


def is_pool_metric(metric: Column) -> Column:
    return _contains_any(metric, "pool", "connection")


def is_latency_metric(metric: Column) -> Column:
    return _contains_any(metric, "p95", "p99", "latency", "duration")


def joined(*parts) -> Column:
    """Text of all parts in a row; a missing part reads ``null``."""
    return F.concat(*[
        F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts
    ])


def cluster_timeline_text() -> Column:
    name = F.coalesce("exception_class", "message_template", "level")
    prefix = F.when(F.col("spike"), C.SPIKE_PREFIX).otherwise(C.PLAIN_PREFIX)
    return joined(prefix, name, C.TIMES, F.col("count"))


def cluster_evidence_text() -> Column:
    name = F.coalesce("exception_class", "message_template")
    prefix = F.when(F.col("spike"), C.SPIKE_EVIDENCE_PREFIX).otherwise("")
    return joined(prefix, name, C.TIMES, F.col("count"))


def slow_sql_timeline_text() -> Column:
    return joined(C.SLOW_SQL_PREFIX, F.col("avg_duration_ms"), "ms: ", F.col("sql_template"))


def slow_sql_evidence_text() -> Column:
    return joined("avg=", F.col("avg_duration_ms"), "ms" + C.TIMES, F.col("occurrences"), ": ", F.col("sql_template"))


def change_evidence_text() -> Column:
    return joined(F.col("type"), " ", render_map(F.col("attributes")))


def health_text() -> Column:
    return joined(
        C.HEALTH_PREFIX, F.col("active_connections"), " idle=", F.col("idle_connections"),
        " waiting=", F.col("waiting_connections"),
        C.LONG_TRANSACTIONS_PART, F.col("long_transactions"), C.LOCK_WAITS_PART, F.col("lock_waits"),
    )
