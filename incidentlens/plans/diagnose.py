"""The whole diagnosis of many requests as one set of jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens.operators import budget as B
from incidentlens.operators import report as P
from incidentlens.operators.clustering import attach_samples, log_clusters
from incidentlens.operators.correlation import rule_candidates
from incidentlens.operators.integrity import resolved_candidates
from incidentlens.operators.joins import request_evidence
from incidentlens.operators.sanitize import redact_questions, sanitize_changes, sanitize_metrics, sanitize_slow_sql
from incidentlens.operators.timeline import evidence_rows, order_short_timeline, timeline_entries
from incidentlens.schemas import REQUEST_HEALTH
from incidentlens.session import RequestScope, materialize, materialize_all, request_scope
from incidentlens.sources.database import route_slow_sql
from incidentlens.sources.evidence import rollup_slow_sql, unavailable_sources
from incidentlens.sources.logs import kept_level


@dataclass(frozen=True)
class Settings:
    """Windows, thresholds and caps of a diagnosis."""

    current_seconds: float = C.CURRENT_WINDOW_SECONDS
    spike_absolute: int = C.SPIKE_ABSOLUTE
    spike_ratio: float = C.SPIKE_RATIO
    deploy_back: float = C.DEPLOY_BACKWARD_SECONDS
    deploy_forward: float = C.DEPLOY_FORWARD_SECONDS
    sql_window: float = C.SQL_METRIC_WINDOW_SECONDS
    caps: tuple[int, int, int, int] = field(
        default=(C.BUDGET_CLUSTERS, C.BUDGET_SLOW_SQL, C.BUDGET_METRICS, C.BUDGET_CHANGES))
    model_name: str = "rules"


@dataclass
class Evidence:
    """Evidence tables as the sources deliver them."""

    logs: DataFrame
    metrics: DataFrame
    changes: DataFrame
    raw_slow_sql: DataFrame | None = None
    slow_sql: DataFrame | None = None
    #: A table, or a function that makes it at the same time as the other evidence.
    health: DataFrame | Callable[[], DataFrame] | None = None
    status: DataFrame | None = None
    capped_logs: DataFrame | None = None


@dataclass
class Diagnosis:
    """What a diagnosis yields; every table is keyed by ``request_id``.

    Evidence rows and candidates are computed and written when first asked for. ``changes`` and ``metrics`` are the sanitized
    rows inside the ranges as plans; ``spots`` has them written without their texts, for rules and counts.
    """

    requests: DataFrame
    clusters: DataFrame
    kept: dict[str, DataFrame]
    unavailable: DataFrame
    health: DataFrame
    logs: DataFrame
    settings: Settings
    changes: DataFrame
    metrics: DataFrame
    slow_sql: DataFrame
    spots: dict[str, DataFrame]
    few: bool

    def _kept(self) -> list[DataFrame]:
        return [self.kept[kind] for kind in ("log_clusters", "metrics", "slow_sql", "change_events")]

    @cached_property
    def evidence(self) -> DataFrame:
        return materialize(evidence_rows(*self._kept(), self.health))

    @cached_property
    def timeline(self) -> DataFrame:
        clusters, metrics, slow_sql, changes = self._kept()
        return order_short_timeline(timeline_entries(changes, clusters, metrics, slow_sql, self.health))

    @cached_property
    def candidates(self) -> DataFrame:
        s = self.settings
        rules = materialize(rule_candidates(
            self.spots["change_events"], self.clusters, self.slow_sql, self.spots["metrics"], few_requests=self.few,
            deploy_back=s.deploy_back, deploy_forward=s.deploy_forward, sql_window=s.sql_window))
        return materialize(resolved_candidates(rules, self.evidence))

    @cached_property
    def budget(self) -> DataFrame:
        return B.budget_report(
            self.requests, self.clusters, self.slow_sql, self.spots["metrics"], self.spots["change_events"], self.settings.caps)

    def sampled_clusters(self) -> DataFrame:
        """The kept clusters, each with its sanitized first event."""
        return attach_samples(self.kept["log_clusters"], self.logs)

    def finished(self, created_at: Column, day: str, stored_ids: DataFrame | None = None, parsed: DataFrame | None = None) -> DataFrame:
        """Reports as they are stored (``append_reports``): ids of ``day`` that are not yet taken, time, JSON."""
        taken = self.requests.sparkSession.createDataFrame([], "diagnosis_id string") if stored_ids is None else stored_ids
        ids = P.assign_report_ids(self.requests.select("request_id"), [F.col("request_id")], taken, day)
        return P.stored_rows(self.reports(parsed), ids, created_at)

    def model_inputs(self) -> DataFrame:
        return P.model_inputs(
            redact_questions(self.requests), self.sampled_clusters(), self.kept["metrics"], self.kept["slow_sql"],
            self.kept["change_events"], self.health, self.timeline, self.candidates, self.unavailable)

    def narration(self) -> DataFrame:
        """The built-in model: fixed texts for the rule candidates."""
        clusters = self.kept["log_clusters"].groupBy("request_id").agg(F.count("*").alias("clusters"))
        entries = self.timeline.groupBy("request_id").agg(F.count("*").alias("entries"))
        counts = self.requests.select("request_id").join(clusters, "request_id", "left").join(entries, "request_id", "left")
        return P.narrate(self.requests, self.candidates, counts)

    def reports(self, parsed: DataFrame | None = None) -> DataFrame:
        """Nested reports from model answers (:func:`parse_model_outputs`), or from the built-in
        narration when none are given. A request without a valid answer gets the fallback."""
        answers = self.narration() if parsed is None else parsed
        explained = P.merge_explanations(self.candidates, answers)
        heads = P.with_fallback(self.requests, answers, self.candidates, self.settings.model_name)
        return P.assemble_reports(
            self.requests, heads, self.timeline, explained, self.evidence, self.unavailable, self.budget)


def request_slow_sql(requests: DataFrame, raw: DataFrame, scope=None) -> DataFrame:
    """Slow SQL per request and template from raw statements inside the range."""
    return rollup_slow_sql(request_evidence(requests, raw, scope=scope), "request_id")


def diagnose(requests: DataFrame, evidence: Evidence, settings: Settings = Settings(),
             database_slow_sql: DataFrame | None = None, projects: DataFrame | None = None) -> Diagnosis:
    """Diagnose accepted requests.

    Evidence inside the ranges is found once and written, since rules, budget and counts all read
    it; texts of metrics and changes are sanitized for the kept rows only. From the budget on, a
    request has at most a few dozen rows. Timeline entries are made from kept evidence only, so
    each of them resolves.
    """
    requests = materialize(requests)
    scope = request_scope(requests)
    spark, caps = requests.sparkSession, settings.caps
    metrics = request_evidence(requests, evidence.metrics, "observed_at", scope)
    changes = request_evidence(requests, evidence.changes, scope=scope)

    def health() -> DataFrame:
        given = evidence.health() if callable(evidence.health) else evidence.health
        return spark.createDataFrame([], REQUEST_HEALTH) if given is None else given

    written_health, clusters, slow_sql, metric_spots, change_spots, kept_metrics, kept_changes = materialize_all(
        health,
        lambda: log_clusters(
            requests, kept_level(evidence.logs), current_seconds=settings.current_seconds,
            absolute=settings.spike_absolute, ratio=settings.spike_ratio, capped=evidence.capped_logs, scope=scope),
        lambda: sanitize_slow_sql(_slow_sql_rows(requests, evidence, scope, database_slow_sql, projects)),
        lambda: metrics.select("request_id", "evidence_id", "metric", "observed_at", "metric_seq"),
        lambda: changes.select("request_id", "evidence_id", "type", "occurred_at", "change_seq"),
        lambda: sanitize_metrics(B.keep_metrics(metrics, caps[2])),
        lambda: sanitize_changes(B.keep_changes(changes, caps[3])),
    )
    kept = {
        "log_clusters": B.keep_clusters(clusters, caps[0]), "slow_sql": B.keep_slow_sql(slow_sql, caps[1]),
        "metrics": kept_metrics, "change_events": kept_changes,
    }
    unavailable = (
        unavailable_sources(requests, evidence.status) if evidence.status is not None
        else spark.createDataFrame([], "request_id string, unavailable_sources array<string>")
    )
    return Diagnosis(
        requests=requests, clusters=clusters, kept=kept, unavailable=unavailable, health=written_health,
        logs=evidence.logs if evidence.capped_logs is None else evidence.capped_logs, settings=settings,
        changes=sanitize_changes(changes), metrics=sanitize_metrics(metrics), slow_sql=slow_sql,
        spots={"metrics": metric_spots, "change_events": change_spots}, few=scope.small,
    )


def _slow_sql_rows(requests: DataFrame, evidence: Evidence, scope: RequestScope,
                   database_slow_sql: DataFrame | None, projects: DataFrame | None) -> DataFrame:
    if evidence.slow_sql is None:
        summaries = request_slow_sql(requests, evidence.raw_slow_sql, scope)
    elif "request_id" in evidence.slow_sql.columns:
        summaries = evidence.slow_sql
    else:
        summaries = request_evidence(requests, evidence.slow_sql, "first_seen", scope)
    if database_slow_sql is None:
        return summaries
    columns = [c for c in summaries.columns if c in database_slow_sql.columns]
    return route_slow_sql(projects, database_slow_sql.select(columns), summaries.select(columns))
