"""Which evidence stays under a cap: what the question names, then severity, frequency, and the nearest deployment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens.operators.linkage import nearest
from incidentlens.operators.ranking import top_n
from incidentlens.operators.sanitize import redact_questions

#: Words of a question shorter than this name nothing.
LEAST_TERM = 3


def words_in(text: Column) -> Column:
    """Distinct words (letters, digits and _) in lower case; a null text has none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def question_terms(requests: DataFrame) -> DataFrame:
    """The words of every redacted question that can name evidence: one array a request."""
    words = F.filter(words_in(F.col("question")), lambda w: F.length(w) >= LEAST_TERM)
    return redact_questions(requests).select("request_id", words.alias("_terms"))


def with_question_hits(rows: DataFrame, requests: DataFrame, *texts: str) -> DataFrame:
    """Add ``question_hits``: how many of its request's question terms stand in a row's texts as whole words."""
    asked = rows.join(question_terms(requests), "request_id", "left")
    held = words_in(F.concat_ws(" ", *texts))
    hits = F.coalesce(F.size(F.array_intersect(held, F.col("_terms"))), F.lit(0))
    return asked.withColumn("question_hits", F.greatest(hits, F.lit(0))).drop("_terms")


def with_deployment_gap(rows: DataFrame, changes: DataFrame, at: str) -> DataFrame:
    """Add ``deployment_gap_us``: the distance in time to the request's nearest deployment or rollback, null if there is none."""
    deployed = changes.where(F.col("type").isin(C.DEPLOYMENT_TYPES)).select(
        "request_id", F.col("occurred_at").alias("_deployed_at"), F.col("evidence_id").alias("_deployment"))
    keyed = rows.withColumn("_name", F.struct("request_id", "evidence_id"))
    gaps = nearest(keyed, deployed, ["request_id"], "_name", at, "_deployed_at", "_deployment").select(
        "_name.request_id", "_name.evidence_id", F.col("gap_us").alias("deployment_gap_us"))
    return rows.join(gaps, ["request_id", "evidence_id"], "left")


def severity(level: Column) -> Column:
    return F.when(F.upper(level) == "ERROR", 2).when(F.upper(level) == "WARN", 1).otherwise(0)


def keep_asked_clusters(requests: DataFrame, clusters: DataFrame, changes: DataFrame, cap: int = C.BUDGET_CLUSTERS) -> DataFrame:
    """The first ``cap`` clusters of every request: named by the question, more severe, more frequent, nearer to a deployment."""
    texts = ["exception_class", "message_template", "top_stack_frame"]
    rows = with_deployment_gap(with_question_hits(clusters, requests, *texts), changes, "last_seen")
    order = [
        F.desc(F.col("question_hits") > 0), F.desc(severity(F.col("level"))), F.desc("count"),
        F.asc_nulls_last("deployment_gap_us"), F.col("cluster_seq"),
    ]
    return top_n(rows, ["request_id"], order, cap)


def keep_asked_slow_sql(requests: DataFrame, slow_sql: DataFrame, changes: DataFrame, cap: int = C.BUDGET_SLOW_SQL) -> DataFrame:
    """The first ``cap`` templates of every request: named by the question, slower, more frequent, nearer to a deployment."""
    rows = with_deployment_gap(with_question_hits(slow_sql, requests, "sql_template"), changes, "first_seen")
    order = [
        F.desc(F.col("question_hits") > 0), F.desc("avg_duration_ms"), F.desc("occurrences"),
        F.asc_nulls_last("deployment_gap_us"), F.col("evidence_id"),
    ]
    return top_n(rows, ["request_id"], order, cap)
