"""References must resolve: timeline entries and candidates that cite cut evidence are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolved_timeline(entries: DataFrame, survivors: DataFrame) -> DataFrame:
    """Entries without an id, and entries whose evidence survived the budget.

    ``survivors`` has one row per (request, evidence id). Entries without an id carry no join key,
    so they bypass the join instead of meeting in one task.
    """
    ids = survivors.select("request_id", "evidence_id")
    loose = entries.where(F.col("evidence_id").isNull())
    return entries.join(ids, ["request_id", "evidence_id"], "left_semi").unionByName(loose)


def resolved_candidates(candidates: DataFrame, survivors: DataFrame) -> DataFrame:
    """Candidates whose every cited id survived; one without any id is dropped as well."""
    cited = candidates.select("request_id", "label", F.explode("evidence_ids").alias("evidence_id"))
    broken = cited.join(
        survivors.select("request_id", "evidence_id"), ["request_id", "evidence_id"], "left_anti"
    ).select("request_id", "label").distinct()
    return candidates.where(F.size("evidence_ids") > 0).join(broken, ["request_id", "label"], "left_anti")
