"""Stored change events and reports: ingest, upsert, lookup and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens.operators.ranking import number_rows, top_n
from incidentlens.operators.sanitize import sanitize_changes
from incidentlens.operators.validation import validate_changes
from incidentlens.schemas import CHANGE_EVENTS, STORED_REPORTS

REPORT_JSON = "diagnosisId string, projectId string, environment string, summary string, ruleFallback boolean"


# --- change events ------------------------------------------------------------------------------

def prepare_changes(submitted: DataFrame, projects: DataFrame, last_id: int = 0) -> DataFrame:
    """Valid posted events as they are stored: redacted before they rest, with new ids in order."""
    valid = validate_changes(submitted, projects).where(F.col("reject_reason").isNull()).drop("reject_reason")
    numbered = number_rows(sanitize_changes(valid), [], [F.col("received_seq")], "_no")
    sequence = F.col("_no") + F.lit(last_id)
    return numbered.select(
        F.concat(F.lit("event-"), sequence.cast("string")).alias("evidence_id"), "project_id", "environment",
        "type", "occurred_at", "attributes", sequence.alias("change_seq"),
    )


def last_change_id(stored: DataFrame) -> int:
    return stored.agg(F.coalesce(F.max("change_seq"), F.lit(0))).first()[0]


def append_changes(prepared: DataFrame, path: str) -> None:
    """Append to the event table, laid out so that a request reads its own partitions only."""
    dated = prepared.withColumn("occurred_on", F.to_date("occurred_at"))
    dated.write.mode("append").partitionBy("project_id", "environment", "occurred_on").parquet(path)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Stored events; the schema is given, so that an id like ``007`` stays text."""
    return spark.read.schema(f"{CHANGE_EVENTS}, occurred_on date").parquet(path).drop("occurred_on")


# --- reports ------------------------------------------------------------------------------------

def append_reports(reports: DataFrame, path: str) -> None:
    """Append report versions (diagnosis_id, project_id, environment, created_at, version, report_json)."""
    reports.write.mode("append").partitionBy("project_id", "environment").parquet(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Stored report versions; the schema is given, so that an id like ``007`` stays text."""
    return spark.read.schema(STORED_REPORTS).parquet(path)


def latest_reports(versions: DataFrame) -> DataFrame:
    """One row per id, the last written one. Every task first cuts an id to its own newest row."""
    return top_n(versions, ["diagnosis_id"], [F.desc("version")], 1, "_no").drop("_no")


def find_report(versions: DataFrame, diagnosis_id: str) -> DataFrame:
    """The stored report with exactly this id, or no row; the filter reaches the scan."""
    return latest_reports(versions.where(F.col("diagnosis_id") == diagnosis_id))


def report_history(versions: DataFrame, project_id: str | None = None, environment: str | None = None,
                   limit: int = C.HISTORY_DEFAULT_LIMIT) -> DataFrame:
    """Newest reports first. The limit, held between 1 and 200, comes before corrupt rows drop."""
    rows = versions
    for name, value in (("project_id", project_id), ("environment", environment)):
        if value is not None and value.strip():
            rows = rows.where(F.col(name) == value)
    capped = min(max(limit, 1), C.HISTORY_MAX_LIMIT)
    # ids and times choose the page; only its bodies are then moved
    key = ["diagnosis_id", "version"]
    newest = [F.desc("created_at"), F.desc("diagnosis_id")]
    chosen = latest_reports(rows.select(*key, "created_at")).orderBy(*newest).limit(capped)
    return report_heads(rows.join(F.broadcast(chosen.select(*key)), key, "left_semi").orderBy(*newest))


def report_heads(versions: DataFrame) -> DataFrame:
    """What a list of reports shows of each; corrupt ones drop."""
    readable = versions.where(F.try_parse_json("report_json").isNotNull())
    body = readable.withColumn("_r", F.from_json("report_json", REPORT_JSON))
    return body.select(
        F.col("_r.diagnosisId").alias("diagnosis_id"), F.col("_r.projectId").alias("project_id"),
        F.col("_r.environment").alias("environment"), "created_at", F.col("_r.summary").alias("summary"),
        F.coalesce("_r.ruleFallback", F.lit(False)).alias("rule_fallback"),
    )
