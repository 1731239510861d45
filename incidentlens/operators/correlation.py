"""Rule candidates: evidence of two kinds that lies close together in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens.functions.rules import evidence_strength, is_latency_metric, is_pool_metric
from incidentlens.operators.ranking import top_n
from incidentlens.session import epoch_micros, interval

ORDER = ["weight", "seq", "id"]


def first_match(windows: DataFrame, points: DataFrame, few_requests: bool = False) -> DataFrame:
    """Per (request, rule) the first window that holds a point, and its first point:
    ``(request_id, rule, left_id, right_id)``.

    ``windows``: request_id, rule, id, low, high, weight, seq; ``points``: request_id, rule, id,
    at, weight, seq; both ordered by weight, seq, id. All windows of a rule have the same
    ``width`` in microseconds, given on both sides.

    No pairs are formed to find the window. Time is cut into buckets as wide as the window, so a
    window meets one bucket and the next: it holds a point exactly when the latest point of the
    first bucket or the earliest point of the second one lies inside. Two numbers per bucket
    answer that. Only the one window chosen per request is then compared with its points.
    """
    keys = ["request_id", "rule"]
    spots = points.where("at IS NOT NULL").withColumn("bucket", _bucket("at")).drop("width")
    edges = spots.selectExpr(
        *keys, "inline(array(named_struct('bucket', bucket, 'latest', at, 'earliest', CAST(NULL AS TIMESTAMP_NTZ)),"
        " named_struct('bucket', bucket - 1, 'latest', CAST(NULL AS TIMESTAMP_NTZ), 'earliest', at)))",
    ).groupBy(*keys, "bucket").agg(F.max("latest").alias("latest"), F.min("earliest").alias("earliest"))
    dated = windows.where("low IS NOT NULL").withColumn("bucket", _bucket("low"))
    matched = dated.join(edges, [*keys, "bucket"]).where("latest >= low OR earliest <= high")
    order = [F.col(c) for c in ORDER]
    chosen = top_n(matched, keys, order, 1).selectExpr(*keys, "id AS left_id", "low", "high")
    # At most one row per request and rule, so its size is bounded by the counted requests.
    picked = F.broadcast(chosen) if few_requests else chosen
    partners = points.join(picked, keys).where("at BETWEEN low AND high")
    return top_n(partners, keys, order, 1).selectExpr(*keys, "left_id", "id AS right_id")


def _bucket(ts: str) -> Column:
    return F.floor(epoch_micros(F.col(ts)) / F.col("width").cast("decimal(20,0)")).cast("long")


def _micros(seconds: float) -> str:
    return f"CAST({max(int(seconds * 1_000_000), 1)} AS BIGINT) AS width"


def _deploy_parts(changes: DataFrame, clusters: DataFrame, back: float, forward: float) -> tuple[DataFrame, DataFrame]:
    rule, width = f"'{C.DEPLOYMENT_REGRESSION}' AS rule", _micros(back + forward)
    windows = changes.where(F.col("type").isin(C.DEPLOYMENT_TYPES)).withColumns({
        "low": F.col("occurred_at") - interval(back), "high": F.col("occurred_at") + interval(forward),
    }).selectExpr("request_id", rule, "evidence_id AS id", "low", "high", "0L AS weight", "change_seq AS seq", width)
    points = clusters.where("spike").selectExpr(
        "request_id", rule, "evidence_id AS id", "last_seen AS at", "-count AS weight", "cluster_seq AS seq", width)
    return windows, points


def _sql_parts(slow_sql: DataFrame, metrics: DataFrame, rules: dict[str, Column], window: float) -> tuple[DataFrame, DataFrame]:
    width = _micros(2 * window)
    windows = slow_sql.withColumns({
        "low": F.col("first_seen") - interval(window), "high": F.col("first_seen") + interval(window),
        "rule": F.explode(F.array(*[F.lit(rule) for rule in rules])),
    }).selectExpr("request_id", "rule", "evidence_id AS id", "low", "high", "-avg_duration_ms AS weight", "sql_seq AS seq", width)
    fitting = F.filter(F.array(*[F.when(fits, F.lit(rule)) for rule, fits in rules.items()]), lambda r: r.isNotNull())
    points = metrics.withColumn("rule", F.explode(fitting)).selectExpr(
        "request_id", "rule", "evidence_id AS id", "observed_at AS at", "0L AS weight", "metric_seq AS seq", width)
    return windows, points


def _candidates(matches: DataFrame) -> DataFrame:
    """Matches as candidates; a latency correlation gives way to a pool contention."""
    position = F.when(F.col("rule") == C.DEPLOYMENT_REGRESSION, 1).otherwise(2)
    placed = matches.withColumn("position", position)
    latency_last = [F.col("rule") == C.LATENCY_CORRELATION]
    strongest = top_n(placed, ["request_id", "position"], latency_last, 1)
    titles = F.create_map(*[F.lit(text) for pair in C.CANDIDATE_TITLES.items() for text in pair])
    return strongest.select(
        "request_id", "position", F.col("rule").alias("label"), titles[F.col("rule")].alias("title"),
        F.lit(None).cast("string").alias("explanation"),
        evidence_strength(F.lit(2), F.lit(False), F.col("rule") != C.LATENCY_CORRELATION).alias("strength"),
        F.array("left_id", "right_id").alias("evidence_ids"),
    )


def deployment_regression(changes: DataFrame, clusters: DataFrame, *, few_requests: bool = False,
                          back: float = C.DEPLOY_BACKWARD_SECONDS,
                          forward: float = C.DEPLOY_FORWARD_SECONDS) -> DataFrame:
    """First deployment or rollback near the last occurrence of a spiking cluster."""
    return _candidates(first_match(*_deploy_parts(changes, clusters, back, forward), few_requests))


def slow_sql_candidates(slow_sql: DataFrame, metrics: DataFrame, *, few_requests: bool = False,
                        window: float = C.SQL_METRIC_WINDOW_SECONDS) -> DataFrame:
    """Slowest SQL with a connection-pool anomaly nearby; where a request has none, with a
    latency anomaly nearby."""
    return _candidates(first_match(*_sql_parts(slow_sql, metrics, _sql_rules(), window), few_requests))


def _sql_rules() -> dict[str, Column]:
    metric = F.col("metric")
    return {C.POOL_CONTENTION: is_pool_metric(metric), C.LATENCY_CORRELATION: is_latency_metric(metric)}


def pool_contention(slow_sql: DataFrame, metrics: DataFrame, **options) -> DataFrame:
    return slow_sql_candidates(slow_sql, metrics, **options).where(F.col("label") == C.POOL_CONTENTION)


def latency_correlation(slow_sql: DataFrame, metrics: DataFrame, **options) -> DataFrame:
    return slow_sql_candidates(slow_sql, metrics, **options).where(F.col("label") == C.LATENCY_CORRELATION)


def rule_candidates(changes: DataFrame, clusters: DataFrame, slow_sql: DataFrame, metrics: DataFrame, *,
                    few_requests: bool = False, deploy_back: float = C.DEPLOY_BACKWARD_SECONDS,
                    deploy_forward: float = C.DEPLOY_FORWARD_SECONDS,
                    sql_window: float = C.SQL_METRIC_WINDOW_SECONDS) -> DataFrame:
    """At most two candidates per request, in rule order; all rules run in one pass."""
    parts = [
        _deploy_parts(changes, clusters, deploy_back, deploy_forward),
        _sql_parts(slow_sql, metrics, _sql_rules(), sql_window),
    ]
    windows, points = (reduce(DataFrame.unionByName, side) for side in zip(*parts))
    return _candidates(first_match(windows, points, few_requests))
