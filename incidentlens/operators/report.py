"""Model inputs and outputs, narration, fallback, report ids and report assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens.functions.text import not_blank
from incidentlens.operators.ranking import number_rows


def ordered_list(order: Column, value: Column, when: Column) -> Column:
    """Values of the rows that meet ``when``, in ``order``; for lists the budget keeps short."""
    pairs = F.collect_list(F.when(when, F.struct(order.alias("o"), value.alias("v"))))
    by_order = F.array_sort(pairs, lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0))
    return F.transform(by_order, lambda p: p["v"])


# --- model contract -----------------------------------------------------------------------------

def parse_model_outputs(outputs: DataFrame) -> DataFrame:
    """``valid``, summary, candidates and actions of every raw answer; nothing is thrown.

    An answer is valid when it is a JSON object with a textual ``summary``. Candidates that are no
    objects or have a blank label are dropped, each by itself; missing texts are empty, missing or
    malformed lists too. Of a repeated key the last one counts (a setting of ``configure``).
    """
    parsed = outputs.withColumn("_json", F.try_parse_json("raw_json"))
    kind = F.schema_of_variant(F.try_variant_get("_json", "$.summary", "variant"))
    read = parsed.withColumn("valid", F.coalesce(kind == "STRING", F.lit(False)))
    listed = [F.when(F.col("valid"), F.try_variant_get("_json", f"$.{name}", "array<variant>")).alias(alias)
              for name, alias in (("rootCauseCandidates", "_found"), ("recommendedActions", "_actions"))]
    body = read.select(*outputs.columns, "valid", "_json", *listed)
    candidates = F.transform(
        F.filter("_found", lambda c: F.schema_of_variant(c).startswith("OBJECT")),
        lambda c: F.struct(
            *[_text_of(F.try_variant_get(c, f"$.{name}", "variant")).alias(name) for name in ("label", "title", "explanation")],
            F.transform(
                F.coalesce(F.try_variant_get(c, "$.evidenceIds", "array<variant>"), F.array().cast("array<variant>")), _text_of,
            ).alias("evidenceIds"),
        ))
    none = F.array().cast("array<struct<label:string,title:string,explanation:string,evidenceIds:array<string>>>")
    return body.select(
        *outputs.columns, "valid", F.when(F.col("valid"), F.try_variant_get("_json", "$.summary", "string")).alias("summary"),
        F.coalesce(F.filter(candidates, lambda c: not_blank(c["label"])), none).alias("model_candidates"),
        F.coalesce(F.transform("_actions", _text_of), F.array().cast("array<string>")).alias("recommended_actions"),
    )


def _text_of(value: Column) -> Column:
    """The text of a scalar; empty for a missing one, an object or an array."""
    kind = F.schema_of_variant(value)
    scalar = ~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    return F.coalesce(F.when(scalar, F.try_variant_get(value, "$", "string")), F.lit(""))


def merge_explanations(candidates: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rule candidates with the model's first non-blank explanation for their label."""
    told = parsed.where("valid").select("request_id", F.posexplode("model_candidates").alias("pos", "c"))
    first = (
        told.where(not_blank(F.col("c.explanation")))
        .groupBy("request_id", F.col("c.label").alias("label"))
        .agg(F.min_by("c.explanation", "pos").alias("_told"))
    )
    merged = candidates.join(first, ["request_id", "label"], "left")
    return merged.withColumn("explanation", F.coalesce("_told", "explanation")).drop("_told").select(*candidates.columns)


# --- built-in narration -------------------------------------------------------------------------

def rule_texts(spark: SparkSession) -> DataFrame:
    """The three-row table of explanations and actions per rule label."""
    rows = [(label, C.EXPLANATIONS[label], C.ACTIONS[label]) for label in C.CANDIDATE_TITLES]
    return spark.createDataFrame(rows, "label string, rule_explanation string, actions array<string>")


def narrate(requests: DataFrame, candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """A fixed-text answer per request: summary, candidates with explanation, actions.

    ``counts`` holds ``clusters`` and ``entries`` (kept clusters and timeline entries).
    """
    texts = rule_texts(requests.sparkSession)
    told = candidates.join(F.broadcast(texts), "label", "left")
    per_request = told.groupBy("request_id").agg(
        F.min_by(F.struct("title", "strength"), "position").alias("_top"),
        ordered_list(F.col("position"), F.coalesce("actions", F.array(F.lit(C.REVIEW_ACTION))), F.lit(True)).alias("_actions"),
        ordered_list(F.col("position"), F.struct(
            "label", "title", F.coalesce("rule_explanation", F.lit(C.DEFAULT_EXPLANATION)).alias("explanation"),
            F.col("evidence_ids").alias("evidenceIds")), F.lit(True)).alias("model_candidates"),
    )
    joined = requests.select("request_id").join(per_request, "request_id", "left").join(counts, "request_id", "left")
    empty, top = C.NO_CAUSE_SUMMARY, C.TOP_CAUSE_SUMMARY
    nothing = F.concat(
        F.lit(empty[0]), F.coalesce("clusters", F.lit(0)).cast("string"),
        F.lit(empty[1]), F.coalesce("entries", F.lit(0)).cast("string"), F.lit(empty[2]))
    found = F.concat(F.lit(top[0]), F.col("_top.title"), F.lit(top[1]), F.col("_top.strength"), F.lit(top[2]))
    none = F.array().cast("array<struct<label:string,title:string,explanation:string,evidenceIds:array<string>>>")
    return joined.select(
        "request_id", F.lit(True).alias("valid"), F.when(F.col("_top").isNull(), nothing).otherwise(found).alias("summary"),
        F.coalesce("model_candidates", none).alias("model_candidates"),
        F.coalesce(F.flatten("_actions"), F.array(F.lit(C.WIDEN_ACTION))).alias("recommended_actions"),
    )


# --- fallback and assembly ----------------------------------------------------------------------

def with_fallback(requests: DataFrame, parsed: DataFrame, candidates: DataFrame, model_name: str) -> DataFrame:
    """Answer head per request: the model's, or the fixed fallback where there is no valid one."""
    has = candidates.select("request_id", F.lit(True).alias("_has")).distinct()
    joined = (
        requests.select("request_id")
        .join(parsed.select("request_id", "valid", "summary", "recommended_actions"), "request_id", "left")
        .join(has, "request_id", "left")
    )
    fallback = ~F.coalesce("valid", F.lit(False))
    fixed = F.when(F.col("_has"), C.FALLBACK_SUMMARY).otherwise(C.FALLBACK_SUMMARY_EMPTY)
    return joined.select(
        "request_id", fallback.alias("rule_fallback"),
        F.when(fallback, fixed).otherwise(F.col("summary")).alias("summary"),
        F.when(fallback, F.array(F.lit(C.REVIEW_ACTION))).otherwise(F.col("recommended_actions")).alias("recommended_actions"),
        F.when(fallback, F.array(F.lit(f"model:{model_name} (error)")))
        .otherwise(F.array().cast("array<string>")).alias("model_unavailable"),
    )


def assemble_reports(requests: DataFrame, heads: DataFrame, timeline: DataFrame, candidates: DataFrame,
                     evidence: DataFrame, unavailable: DataFrame, budget: DataFrame) -> DataFrame:
    """Nested reports. Every part is short per request, and all meet in one shuffle."""
    pieces = [
        timeline.select("request_id", F.lit("t").alias("part"), F.col("position").cast("long").alias("a"),
                        F.lit(0).cast("long").alias("b"), F.struct("at", "category", "description", "evidence_id").alias("t")),
        candidates.select("request_id", F.lit("c").alias("part"), F.col("position").cast("long").alias("a"),
                          F.lit(0).cast("long").alias("b"),
                          F.struct("label", "title", "explanation", "strength", "evidence_ids").alias("c")),
        evidence.select("request_id", F.lit("e").alias("part"), F.col("type_ord").cast("long").alias("a"),
                        F.col("rank_no").cast("long").alias("b"), F.struct("evidence_id", "type", "description").alias("e")),
    ]
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), pieces)
    order = F.struct("a", "b")
    parts = stacked.groupBy("request_id").agg(*[
        ordered_list(order, F.col(tag), F.col("part") == tag).alias(name)
        for tag, name in (("t", "timeline"), ("c", "root_cause_candidates"), ("e", "evidence"))
    ])
    base = requests.select("request_id", "project_id", "environment")
    joined = reduce(lambda x, y: x.join(y, "request_id", "left"), [base, heads, parts, unavailable, budget])
    kinds = [c for c in budget.columns if c != "request_id"]
    return joined.select(
        "request_id", "project_id", "environment", "summary",
        *[F.coalesce(c, F.array()).alias(c) for c in ("timeline", "root_cause_candidates")],
        "recommended_actions", F.coalesce("evidence", F.array()).alias("evidence"),
        F.concat(F.coalesce("unavailable_sources", F.array().cast("array<string>")), "model_unavailable").alias("unavailable_sources"),
        F.struct(*kinds).alias("budget"), "rule_fallback", F.lit(C.DISCLAIMER).alias("disclaimer"),
    )


def report_id(day: str, number: Column) -> Column:
    """``diag-<day>-NNN``; numbers from 1000 on keep all their digits."""
    text = number.cast("string")
    return F.concat(F.lit(f"diag-{day}-"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def assign_report_ids(requests: DataFrame, order: list[Column], stored_ids: DataFrame, day: str) -> DataFrame:
    """``diag-<day>-NNN`` for every request in order, never an id that is already stored.

    The free numbers and the requests are numbered alike and joined on that number.
    """
    spark = requests.sparkSession
    prefix = f"diag-{day}-"
    taken = stored_ids.where(F.col("diagnosis_id").startswith(prefix)).select(
        F.expr(f"try_cast(substring(diagnosis_id, {len(prefix) + 1}) AS BIGINT)").alias("number")
    ).where("number > 0").distinct()
    queue = number_rows(requests, [], order, "turn_no")
    needed = queue.count() + taken.count()
    free = spark.range(1, needed + 1).withColumnRenamed("id", "number").join(taken, "number", "left_anti")
    numbered = number_rows(free, [], [F.col("number")], "turn_no")
    return queue.join(numbered, "turn_no").withColumn("diagnosis_id", report_id(day, F.col("number"))).drop("turn_no", "number")


def stored_rows(reports: DataFrame, ids: DataFrame, created_at: Column, version: int = 1) -> DataFrame:
    """Finished reports as they are stored: id, time, version and the whole report as JSON.

    ``ids`` has ``request_id`` and ``diagnosis_id``.
    """
    named = reports.join(ids.select("request_id", "diagnosis_id"), "request_id").withColumn("created_at", created_at)
    body = F.struct(
        F.col("diagnosis_id").alias("diagnosisId"), F.col("project_id").alias("projectId"), "environment",
        F.col("created_at").alias("createdAt"), "summary", "timeline", F.col("root_cause_candidates").alias("rootCauseCandidates"),
        F.col("recommended_actions").alias("recommendedActions"), "evidence",
        F.col("unavailable_sources").alias("unavailableSources"), "budget", F.col("rule_fallback").alias("ruleFallback"), "disclaimer",
    )
    return named.select(
        "diagnosis_id", "project_id", "environment", "created_at", F.lit(version).cast("long").alias("version"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("report_json"))


def model_inputs(requests: DataFrame, clusters: DataFrame, metrics: DataFrame, slow_sql: DataFrame,
                 changes: DataFrame, health: DataFrame, timeline: DataFrame, candidates: DataFrame,
                 unavailable: DataFrame) -> DataFrame:
    """One compact JSON text per request from its redacted question and budgeted evidence."""
    def piece(df: DataFrame, tag: str, order: Column, value: Column) -> DataFrame:
        return df.select("request_id", F.lit(tag).alias("part"), order.cast("long").alias("o"), value.alias(tag))

    rank = F.col("rank_no")
    pieces = [
        piece(clusters, "logClusters", rank, F.struct(
            F.col("evidence_id").alias("evidenceId"), F.col("cluster_key").alias("clusterKey"),
            F.col("exception_class").alias("exceptionClass"), F.col("message_template").alias("messageTemplate"),
            F.col("top_stack_frame").alias("topStackFrame"), "level", "count",
            F.col("baseline_count").alias("baselineCount"), "spike", F.col("first_seen").alias("firstSeen"),
            F.col("last_seen").alias("lastSeen"), *(["sample"] if "sample" in clusters.columns else []))),
        piece(metrics, "metricAnomalies", rank, F.struct(
            F.col("evidence_id").alias("evidenceId"), "metric", "description", F.col("baseline_value").alias("baselineValue"),
            F.col("current_value").alias("currentValue"), "unit", F.col("observed_at").alias("observedAt"))),
        piece(slow_sql, "slowSqlSummaries", rank, F.struct(
            F.col("evidence_id").alias("evidenceId"), F.col("sql_template").alias("sqlTemplate"), "occurrences",
            F.col("avg_duration_ms").alias("avgDurationMs"), F.col("max_duration_ms").alias("maxDurationMs"),
            F.col("first_seen").alias("firstSeen"), "source")),
        piece(changes, "changeEvents", rank, F.struct(
            F.col("evidence_id").alias("evidenceId"), F.col("project_id").alias("projectId"), "environment", "type",
            F.col("occurred_at").alias("occurredAt"), "attributes")),
        piece(health, "databaseHealth", F.lit(1), F.struct(
            F.col("evidence_id").alias("evidenceId"), "available", F.col("unavailable_reason").alias("unavailableReason"),
            F.col("active_connections").alias("activeConnections"), F.col("idle_connections").alias("idleConnections"),
            F.col("waiting_connections").alias("waitingConnections"),
            F.col("long_transactions").alias("longTransactions"), F.col("lock_waits").alias("lockWaits"))),
        piece(timeline, "timeline", F.col("position"), F.struct(
            "at", "category", "description", F.col("evidence_id").alias("evidenceId"))),
        piece(candidates, "ruleCandidates", F.col("position"), F.struct(
            "label", "title", "explanation", "strength", F.col("evidence_ids").alias("evidenceIds"))),
    ]
    tags = ["logClusters", "metricAnomalies", "slowSqlSummaries", "changeEvents", "databaseHealth", "timeline", "ruleCandidates"]
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), pieces)
    parts = stacked.groupBy("request_id").agg(*[
        ordered_list(F.col("o"), F.col(tag), F.col("part") == tag).alias(tag) for tag in tags
    ])
    joined = requests.join(parts, "request_id", "left").join(unavailable, "request_id", "left")
    payload = F.struct(
        "question", F.col("from_ts").alias("from"), F.col("to_ts").alias("to"),
        *[F.coalesce(tag, F.array()).alias(tag) for tag in tags],
        F.coalesce("unavailable_sources", F.array().cast("array<string>")).alias("unavailableSources"),
    )
    return joined.select("request_id", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))
