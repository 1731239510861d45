"""Scoring reports against expected root causes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.functions.text import not_blank


def score_reports(scenarios: DataFrame, reports: DataFrame, candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Five checks per scenario and whether all of them passed.

    ``scenarios``: report_id, expected_label, required_ids; ``reports``: report_id, summary,
    rule_fallback; ``candidates``: report_id, label, evidence_ids; ``evidence``: report_id,
    evidence_id. Ids are compared as joined rows, so a report of any size is spread over tasks.
    """
    cited = candidates.select("report_id", "label", F.explode("evidence_ids").alias("evidence_id"))
    expected = scenarios.select("report_id", F.col("expected_label").alias("label"))
    hits = candidates.join(expected, ["report_id", "label"], "left_semi").select(
        "report_id", F.lit("hit").alias("mark"))
    required = scenarios.select(
        "report_id", F.col("expected_label").alias("label"), F.explode("required_ids").alias("evidence_id"))
    missing = required.join(cited, ["report_id", "label", "evidence_id"], "left_anti").select(
        "report_id", F.lit("missing").alias("mark"))
    fabricated = cited.select("report_id", "evidence_id").distinct().join(
        evidence, ["report_id", "evidence_id"], "left_anti").select("report_id", F.lit("fabricated").alias("mark"))
    marks = hits.unionByName(missing).unionByName(fabricated).groupBy("report_id").agg(
        *[F.count_if(F.col("mark") == m).alias(f"_{m}") for m in ("hit", "missing", "fabricated")])
    joined = scenarios.join(reports, "report_id").join(marks, "report_id", "left").fillna(
        0, ["_hit", "_missing", "_fabricated"])
    scored = joined.select(
        "report_id", (F.col("_hit") > 0).alias("root_cause_hit"),
        ((F.col("_hit") > 0) & (F.col("_missing") == 0)).alias("evidence_cited"),
        (F.col("_fabricated") == 0).alias("no_fabricated_ids"),
        (~F.col("rule_fallback")).alias("model_answered"),
        not_blank(F.col("summary")).alias("summary_present"),
        F.col("_missing").alias("missing_ids"), F.col("_fabricated").alias("fabricated_ids"),
    )
    passed = (F.col("root_cause_hit") & F.col("evidence_cited") & F.col("no_fabricated_ids")
              & F.col("model_answered") & F.col("summary_present"))
    return scored.withColumn("passed", passed)


def score_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count_if("passed").alias("passed"), F.count("*").alias("scenarios"))
