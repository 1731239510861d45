"""Posted batches of change events: bounds, freshness, and each request id only once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens.functions.text import not_blank


def batch_reason(max_events: int, max_age: float = C.BATCH_MAX_AGE_SECONDS, batch_bytes: int = C.BATCH_MAX_BYTES,
                 event_bytes: int = C.BATCH_EVENT_MAX_BYTES) -> Column:
    """Why a posted batch is refused, whatever came before it; null if it is not.

    Columns: request_id, sent_at, received_at, token_project, token_environments, project_id, environment and
    events (type, occurred_at, attributes, bytes).
    """
    bound = F.coalesce(F.col("project_id") == F.col("token_project"), F.lit(False))
    allowed = F.coalesce(F.array_contains("token_environments", F.col("environment")), F.lit(False))
    age = F.col("received_at") - F.col("sent_at")
    limit = F.expr(f"INTERVAL '{max_age}' SECOND")
    fresh = F.coalesce((age <= limit) & (age >= -limit), F.lit(False))
    sizes = F.transform("events", lambda e: F.coalesce(e["bytes"], F.lit(0).cast("long")))
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        F.when(~not_blank(F.col("request_id")), "blank-request-id").when(~bound, "project-mismatch").when(~allowed, "environment-not-allowed")
        .when(~fresh, "stale").when(F.coalesce(F.size("events"), F.lit(0)) < 1, "empty")
        .when(F.size("events") > max_events, "too-many-events").when(total > batch_bytes, "batch-too-large")
        .when(F.exists(sizes, lambda x: x > event_bytes), "event-too-large")
    )


def judge_batches(batches: DataFrame, max_events: int, **limits) -> DataFrame:
    """Every batch with ``reject_reason``: of acceptable ones with the same token project and request id the first received counts,
    the others are ``duplicate``. ``received_seq`` orders batches received at the same time."""
    judged = batches.withColumn("_reason", batch_reason(max_events, **limits))
    fine = F.col("_reason").isNull()
    same = Window.partitionBy("token_project", "request_id", fine).orderBy("received_at", "received_seq")
    repeat = F.when(fine & (F.row_number().over(same) > 1), "duplicate")
    return judged.withColumn("reject_reason", F.coalesce("_reason", repeat)).drop("_reason")


def batch_events(judged: DataFrame) -> DataFrame:
    """The events of accepted batches, one row each, as :func:`prepare_changes` takes them."""
    rows = judged.where(F.col("reject_reason").isNull()).select(
        "received_seq", "project_id", "environment", F.posexplode("events").alias("_place", "_event"))
    return rows.select(
        (F.col("received_seq") * C.BATCH_MAX_EVENTS + F.col("_place")).alias("received_seq"), "project_id", "environment",
        "_event.type", "_event.occurred_at", "_event.attributes")


def batch_audit(judged: DataFrame) -> DataFrame:
    """Number of batches and events by token project, project, and result."""
    return judged.groupBy("token_project", "project_id", F.coalesce("reject_reason", F.lit("accepted")).alias("result")).agg(
        F.count("*").alias("batches"), F.sum(F.coalesce(F.size("events"), F.lit(0)).cast("long")).alias("events"))
