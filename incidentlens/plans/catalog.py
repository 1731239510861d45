"""One runnable query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.functions import logline as L
from incidentlens.functions import rules as R
from incidentlens.functions import text as X
from incidentlens.operators import audit as U
from incidentlens.operators import batches as N
from incidentlens.operators import budget as B
from incidentlens.operators import clustering as K
from incidentlens.operators import correlation as J
from incidentlens.operators import evaluation as V
from incidentlens.operators import integrity as I
from incidentlens.operators import linkage as W
from incidentlens.operators import report as P
from incidentlens.operators import retention as Q
from incidentlens.operators import sanitize as Z
from incidentlens.operators import timeline as T
from incidentlens.operators import validation as A
from incidentlens.operators.joins import request_evidence, wanted_evidence
from incidentlens.operators.ranking import largest
from incidentlens.plans.diagnose import Diagnosis, Evidence, Settings, diagnose, request_slow_sql
from incidentlens.session import instant, materialize, materialize_all, request_scope, scratch_path
from incidentlens.sources import database as D
from incidentlens.sources import driver_tables as E
from incidentlens.sources import evidence as G
from incidentlens.sources import logs as S
from incidentlens.sources import store as O
from incidentlens.sources import textlog as M

#: Windows that fit the density of the given events.
HOUR = 3600
SETTINGS = Settings(
    current_seconds=24 * HOUR, spike_absolute=5, spike_ratio=1.2, deploy_back=6 * HOUR,
    deploy_forward=48 * HOUR, sql_window=6 * HOUR,
)
#: Tight caps under which cut evidence takes candidates and timeline entries with it.
TIGHT = (3, 1, 2, 1)
REPORT_DAY = "20240128"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _list(column: str | Column) -> Column:
    return F.array_join(column, ";")


# --- shared inputs ------------------------------------------------------------------------------

def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The requests, written once for a query that meets them with several kinds of evidence."""
    return materialize(E.requests(spark, d))


def _clusters(spark: SparkSession, d: str, asked: DataFrame | None = None) -> DataFrame:
    s = SETTINGS
    return K.log_clusters(
        _asked(spark, d) if asked is None else asked, S.kept_level(E.log_events(spark, d)),
        current_seconds=s.current_seconds, absolute=s.spike_absolute, ratio=s.spike_ratio)


def _slow_sql(spark: SparkSession, d: str, asked: DataFrame | None = None) -> DataFrame:
    return Z.sanitize_slow_sql(request_slow_sql(_asked(spark, d) if asked is None else asked, E.raw_slow_sql(spark, d)))


def _metrics(spark: SparkSession, d: str, asked: DataFrame | None = None) -> DataFrame:
    asked = _asked(spark, d) if asked is None else asked
    scope = request_scope(asked)
    wanted = wanted_evidence(asked, E.metric_anomalies(spark, d), "observed_at", scope)
    return request_evidence(asked, Z.sanitize_metrics(wanted), "observed_at", scope)


def _changes(spark: SparkSession, d: str, asked: DataFrame | None = None) -> DataFrame:
    asked = _asked(spark, d) if asked is None else asked
    scope = request_scope(asked)
    return request_evidence(asked, Z.sanitize_changes(wanted_evidence(asked, E.change_events(spark, d), scope=scope)), scope=scope)


def _health(spark: SparkSession, d: str, asked: DataFrame | None = None, projects: DataFrame | None = None) -> DataFrame:
    """The snapshots are counted from all captured sessions, so they are written before they are read twice."""
    asked = _asked(spark, d) if asked is None else asked
    projects = E.projects(spark, d) if projects is None else projects
    return D.health_status(asked, projects, materialize(E.health_snapshots(spark, d)))


def diagnosis(spark: SparkSession, d: str, settings: Settings = SETTINGS) -> Diagnosis:
    asked, projects = materialize_all(lambda: E.requests(spark, d), lambda: E.projects(spark, d))
    evidence = Evidence(
        logs=E.log_events(spark, d), metrics=E.metric_anomalies(spark, d), changes=E.change_events(spark, d),
        raw_slow_sql=E.raw_slow_sql(spark, d), health=lambda: _health(spark, d, asked, projects), status=E.source_status(spark, d))
    return diagnose(A.accepted_requests(asked, projects), evidence, settings)


# --- text logs ----------------------------------------------------------------------------------

def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every log row as it would stand in a text file, in three layouts and as a stack line."""
    seq = F.col("arrival_seq")
    stamp = F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSS")
    level = F.upper("level")
    plain = F.concat(stamp, F.lit(" "), level, F.lit(" [worker-"), (seq % 4).cast("string"), F.lit("] "), "logger", F.lit(" - "), "message")
    boot = F.concat(F.translate(stamp, " ", "T"), F.lit("+08:00  "), level, F.lit(" 123 --- [main] "), "logger", F.lit(" : "), "message")
    bare = F.concat(F.translate(stamp, ".", ","), F.lit(" "), level, F.lit(" "), "logger", F.lit(" - "), "message")
    line = F.when(seq % 7 == 0, F.concat(F.lit("\tat "), "logger")).when(seq % 3 == 0, plain).when(seq % 3 == 1, boot).otherwise(bare)
    return E.raw_logs(spark, d).select("arrival_seq", "occurred_at", "level", "message", line.alias("line"))


@query
def multiline_log_events(spark, d):
    raw = E.raw_logs(spark, d)
    level = F.when(F.col("level") == "warn", "DEBUG").otherwise(F.col("level"))
    text = F.concat(
        F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), level, F.lit(" [worker] "),
        "logger", F.lit(" - "), "message", F.coalesce(F.concat(F.lit("\n"), "stack_trace"), F.lit("")))
    path = scratch_path(spark, "textlogs")
    raw.select("project_id", "environment", text.alias("value")).write.partitionBy("project_id", "environment").text(path)
    events = M.parse_events(M.assemble_events(M.read_lines(spark, [path])))
    return events.select(
        F.regexp_extract("file", "project_id=([^/]+)", 1).alias("project_id"),
        F.regexp_extract("file", "environment=([^/]+)", 1).alias("environment"),
        "occurred_at", "level", "logger", "message", "stack_trace",
        F.col("attributes")["exceptionClass"].alias("exception_class"))


@query
def multiline_documents(spark, d):
    events = M.split_document_events(E.table(spark, d, "documents").select("doc_id", "text"))
    return events.select("doc_id", "event_no", "head", "n_lines", M.bound_stack(F.col("continuation")).alias("b")).select(
        "doc_id", "event_no", "head", "n_lines", "b.stack_trace")


@query
def stack_bounds(spark, d):
    lines = F.split("text", "\n")
    rest = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(2)))
    return E.table(spark, d, "documents").select("doc_id", M.bound_stack(rest).alias("b")).select("doc_id", "b.*")


@query
def parse_heads(spark, d):
    line = F.col("line")
    return _log_lines(spark, d).where(L.is_head(line)).select("arrival_seq", *[
        L.head_field(line, name).alias(alias) for name, alias in
        (("ts", "ts"), ("level", "level"), ("thread", "thread"), ("logger", "logger"), ("msg", "msg"))])


@query
def strip_ansi(spark, d):
    colored = F.concat(F.lit("\x1b[31m"), "level", F.lit("\x1b[0;39m "), "message", F.lit("\x1b[m"))
    return E.raw_logs(spark, d).select("arrival_seq", L.strip_ansi(colored).alias("line"))


@query
def parse_timestamps(spark, d):
    stamp, mod = F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSS"), F.col("arrival_seq") % 6
    text = (
        F.when(mod == 0, F.concat(F.translate(stamp, " ", "T"), F.lit("Z")))
        .when(mod == 1, F.translate(stamp, ".", ","))
        .when(mod == 2, F.concat(stamp, F.lit("+08:00")))
        .when(mod == 3, F.concat(F.translate(stamp, " ", "T"), F.lit("-0330")))
        .when(mod == 4, F.concat(F.lit("at "), stamp))
        .otherwise(F.substring(stamp, 1, 19)))
    return E.raw_logs(spark, d).select("arrival_seq", L.parse_timestamp(text, "Asia/Shanghai").alias("occurred_at"))


@query
def zone_shift(spark, d):
    at = F.col("occurred_at")
    return E.raw_logs(spark, d).select(
        "arrival_seq", L.wallclock_to_utc(at, "America/New_York").alias("utc"),
        L.utc_to_wallclock(at, "Asia/Shanghai").alias("wallclock"))


# --- log sources --------------------------------------------------------------------------------

@query
def scan_log_table(spark, d):
    rows = S.scan_log_table(E.requests(spark, d), E.raw_logs(spark, d), "Asia/Shanghai")
    return rows.select(
        "request_id", "occurred_at", "level", "trace_id", "message", "stack_trace",
        F.col("attributes")["exceptionClass"].alias("exception_class"), F.col("rank_no").cast("long").alias("rank_no"))


def _cluster_rows(clusters: DataFrame) -> DataFrame:
    return clusters.select("request_id", "evidence_id", "cluster_key", "level", "count", "baseline_count", "spike", "first_seen", "last_seen")


def _all_clusters(spark: SparkSession, d: str, logs: DataFrame) -> DataFrame:
    s = SETTINGS
    return _cluster_rows(K.log_clusters(
        E.requests(spark, d), logs, current_seconds=s.current_seconds, absolute=s.spike_absolute, ratio=s.spike_ratio))


@query
def log_view_clusters(spark, d):
    """A log view that all projects share, clustered for every request."""
    view = E.raw_logs(spark, d).select("project_id", "environment", "occurred_at", "level", "trace_id", "message", "stack_trace")
    return _all_clusters(spark, d, S.log_view_events(view, F.col("project_id"), F.col("environment"), "Asia/Shanghai"))


@query
def textlog_clusters(spark, d):
    """Text files of all projects, each in its own folder, clustered for every request."""
    text = F.concat(
        F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), F.upper("level"), F.lit(" [worker] "),
        "logger", F.lit(" - "), "message", F.coalesce(F.concat(F.lit("\n"), "stack_trace"), F.lit("")))
    path = scratch_path(spark, "textlog")
    rows = E.raw_logs(spark, d).select("project_id", "environment", text.alias("value"))
    rows.write.partitionBy("project_id", "environment").text(path)
    folder = {name: F.regexp_extract("file", f"/{name}=([^/]+)/", 1) for name in ("project_id", "environment")}
    logs, _ = M.read_log_files(spark, [f"{path}/project_id=*/environment=*"], **folder)
    return _all_clusters(spark, d, logs)


@query
def route_log_sources(spark, d):
    logs = E.log_events(spark, d)
    routed = S.route_logs(E.projects(spark, d), {
        "mock": logs, "local-file": S.kept_level(logs, exact=True), "jdbc": S.kept_level(logs)})
    return routed.select("project_id", "environment", "arrival_seq", "level", "source_type")


@query
def level_filter(spark, d):
    logs = E.raw_logs(spark, d).select("arrival_seq", "level")
    table, file = S.kept_level(logs), S.kept_level(logs, exact=True)
    return table.withColumn("mode", F.lit("table")).unionByName(file.withColumn("mode", F.lit("file")))


@query
def logs_first_n(spark, d):
    rows = request_evidence(E.requests(spark, d), E.raw_logs(spark, d).select("project_id", "environment", "occurred_at", "arrival_seq"))
    return S.first_arrived(rows, 25).select("request_id", "arrival_seq", F.col("rank_no").cast("long").alias("rank_no"))


@query
def recent_logs(spark, d):
    rows = request_evidence(
        E.requests(spark, d),
        S.kept_level(E.raw_logs(spark, d)).select("project_id", "environment", "occurred_at", "arrival_seq"))
    limit = F.col("max_results")
    return S.most_recent(rows, limit, most=largest(E.requests(spark, d), limit)).select(
        "request_id", "occurred_at", "arrival_seq", F.col("rank_no").cast("long").alias("rank_no"))


@query
def request_evidence_rows(spark, d):
    rows = request_evidence(E.requests(spark, d), E.raw_logs(spark, d).select("project_id", "environment", "occurred_at", "arrival_seq"))
    return rows.select("request_id", "arrival_seq", "occurred_at")


QUERIES["request_evidence"] = QUERIES.pop("request_evidence_rows")


# --- metrics, changes, slow SQL -----------------------------------------------------------------

@query
def metrics_in_range(spark, d):
    rows = G.metrics_in_range(E.requests(spark, d), E.metric_anomalies(spark, d), 10)
    return rows.select("request_id", "evidence_id", "metric", "observed_at", "baseline_value", F.col("rank_no").cast("long").alias("rank_no"))


@query
def slow_sql_in_range(spark, d):
    rows = G.slow_sql_in_range(E.requests(spark, d), E.daily_slow_sql(spark, d), 4)
    return rows.select("request_id", "evidence_id", "sql_template", "first_seen", "occurrences", F.col("rank_no").cast("long").alias("rank_no"))


@query
def changes_in_range(spark, d):
    rows = G.changes_in_range(E.requests(spark, d), E.change_events(spark, d))
    return rows.select("request_id", "evidence_id", "type", "occurred_at")


@query
def recent_changes(spark, d):
    rows = G.recent_changes(E.requests(spark, d), E.change_events(spark, d), 3)
    return rows.select("request_id", "evidence_id", "type", "occurred_at", F.col("place").cast("long").alias("place"))


@query
def slow_sql_rollup(spark, d):
    return G.rollup_slow_sql(E.raw_slow_sql(spark, d)).select(
        "project_id", "environment", "evidence_id", "sql_template", "occurrences", "avg_duration_ms", "max_duration_ms", "first_seen")


@query
def unavailable_sources(spark, d):
    rows = G.unavailable_sources(E.requests(spark, d), E.source_status(spark, d))
    return rows.select("request_id", _list("unavailable_sources").alias("unavailable"))


# --- databases ----------------------------------------------------------------------------------

_DIGEST = ["request_id", "evidence_id", "sql_template", "occurrences", "avg_duration_ms", "max_duration_ms", "first_seen", "source"]


@query
def mysql_digest(spark, d):
    return D.mysql_digest(E.requests(spark, d), E.mysql_digests(spark, d)).select(_DIGEST)


@query
def pg_statements(spark, d):
    return D.pg_statements(E.requests(spark, d), E.pg_statements(spark, d)).select(_DIGEST)


@query
def route_slow_sql(spark, d):
    requests, projects = E.requests(spark, d), E.projects(spark, d)
    kinds = projects.select("project_id", D.database_kind(F.col("database_type")).alias("kind"))
    by_kind = requests.join(F.broadcast(kinds), "project_id")
    mysql = D.mysql_digest(by_kind.where("kind = 'mysql'"), E.mysql_digests(spark, d), 10)
    pg = D.pg_statements(by_kind.where("kind = 'postgresql'"), E.pg_statements(spark, d), 10)
    columns = ["project_id", *_DIGEST]
    own = mysql.select(columns).unionByName(pg.select(columns))
    fallback = request_slow_sql(requests, E.raw_slow_sql(spark, d)).select(columns)
    return D.route_slow_sql(projects, own, fallback).drop("first_seen")


@query
def mysql_health(spark, d):
    return D.mysql_health(E.mysql_status(spark, d))


@query
def pg_health(spark, d):
    return D.pg_health(E.pg_activity(spark, d))


@query
def long_transactions(spark, d):
    return D.pg_long_transactions(E.pg_activity(spark, d)).unionByName(
        D.mysql_long_transactions(E.mysql_transactions(spark, d)))


@query
def lock_waits(spark, d):
    return D.pg_lock_waits(E.pg_locks(spark, d)).unionByName(D.mysql_lock_waits(E.mysql_lock_waits(spark, d)))


@query
def health_status(spark, d):
    return _health(spark, d).drop("project_id", "environment", "to_ts", "evidence_id")


# --- stores -------------------------------------------------------------------------------------

@query
def ingest_changes(spark, d):
    stored = O.prepare_changes(E.submitted_changes(spark, d), E.projects(spark, d), last_id=100)
    return stored.select(
        "evidence_id", "project_id", "environment", "type", "occurred_at", X.render_map(F.col("attributes")).alias("attributes"))


@query
def judge_batches(spark, d):
    judged = N.judge_batches(E.posted_batches(spark, d), max_events=5)
    return judged.select("received_seq", "request_id", "project_id", "environment", F.size("events").alias("events"), "reject_reason")


@query
def batch_events(spark, d):
    rows = N.batch_events(N.judge_batches(E.posted_batches(spark, d), max_events=5))
    return rows.select("received_seq", "project_id", "environment", "type", "occurred_at", X.render_map(F.col("attributes")).alias("attributes"))


@query
def batch_audit(spark, d):
    return N.batch_audit(N.judge_batches(E.posted_batches(spark, d), max_events=5))


@query
def report_upsert(spark, d):
    return O.latest_reports(E.stored_reports(spark, d))


@query
def report_find(spark, d):
    return O.find_report(E.stored_reports(spark, d), "diag-5")


@query
def report_history(spark, d):
    return O.report_history(E.stored_reports(spark, d), project_id="svc-2", environment=" ", limit=10)


# --- text functions over whole columns ----------------------------------------------------------

def _documents(spark: SparkSession, d: str) -> DataFrame:
    return E.table(spark, d, "documents").select("doc_id", "text")


@query
def redact_documents(spark, d):
    return _documents(spark, d).select("doc_id", X.redact(F.col("text")).alias("text"))


@query
def truncate_text(spark, d):
    return _documents(spark, d).select("doc_id", X.truncate(F.col("text")).alias("text"))


@query
def limit_stack(spark, d):
    return _documents(spark, d).select("doc_id", X.limit_stack_lines(F.col("text")).alias("text"))


@query
def normalize_messages(spark, d):
    return _documents(spark, d).select("doc_id", X.normalize_message(F.col("text")).alias("template"))


@query
def redact_attributes(spark, d):
    rows = E.submitted_changes(spark, d)
    return rows.select("received_seq", X.render_map(X.redact_map(F.col("attributes"))).alias("attributes"))


@query
def exception_class(spark, d):
    return E.raw_logs(spark, d).select("arrival_seq", X.exception_class(F.col("stack_trace")).alias("exception_class"))


@query
def top_frame(spark, d):
    return E.raw_logs(spark, d).select("arrival_seq", X.top_stack_frame(F.col("stack_trace")).alias("frame"))


@query
def exc_class_fallback(spark, d):
    mod = F.col("arrival_seq") % 3
    explicit = F.when(mod == 0, "GivenException").when(mod == 1, " ")
    return E.raw_logs(spark, d).select(
        "arrival_seq", X.cluster_exception(explicit, F.col("stack_trace")).alias("exception_class"))


@query
def sanitize_logs(spark, d):
    return Z.sanitize_logs(E.log_events(spark, d)).select(
        "arrival_seq", "message", "stack_trace", X.render_map(F.col("attributes")).alias("attributes"))


@query
def sanitize_changes(spark, d):
    return Z.sanitize_changes(E.change_events(spark, d)).select(
        "evidence_id", X.render_map(F.col("attributes")).alias("attributes"))


@query
def sanitize_slow_sql(spark, d):
    raw = E.raw_slow_sql(spark, d)
    noted = raw.withColumn("sql_template", F.concat("sql_template", F.lit(" -- password="), F.col("duration_ms").cast("string")))
    return Z.sanitize_slow_sql(noted).groupBy("sql_template").agg(F.count("*").alias("rows"))


@query
def sanitize_metrics(spark, d):
    return Z.sanitize_metrics(E.metric_anomalies(spark, d)).select("evidence_id", "description")


@query
def redact_question(spark, d):
    return Z.redact_questions(E.submitted_requests(spark, d)).select("request_id", "question")


@query
def cluster_keys(spark, d):
    parts = K.cluster_parts(S.kept_level(E.log_events(spark, d)))
    key = X.cluster_key(F.col("project_id"), F.col("environment"), *[F.col(p) for p in K.PARTS])
    return parts.select("arrival_seq", key.alias("cluster_key"))


@query
def strength(spark, d):
    k = F.col("k")
    return E.events(spark, d).select("event_id", R.evidence_strength(k % 4, k % 2 == 0, k % 3 == 0).alias("strength"))


@query
def classify_metrics(spark, d):
    metric = F.upper("metric")
    return E.metric_anomalies(spark, d).select(
        "evidence_id", R.is_pool_metric(metric).alias("is_pool"), R.is_latency_metric(metric).alias("is_latency"))


# --- validation ---------------------------------------------------------------------------------

@query
def validate_requests(spark, d):
    checked = A.validate_requests(E.submitted_requests(spark, d), E.projects(spark, d))
    return checked.select("request_id", "reject_reason")


@query
def validate_events(spark, d):
    checked = A.validate_changes(E.submitted_changes(spark, d), E.projects(spark, d))
    return checked.select("received_seq", "reject_reason")


# --- clusters and rules -------------------------------------------------------------------------

@query
def log_clusters(spark, d):
    full = K.attach_samples(_clusters(spark, d), E.log_events(spark, d))
    return full.select(
        "request_id", "evidence_id", "cluster_key", *K.PARTS, "level", "count", "baseline_count", "spike",
        "first_seen", "last_seen", F.col("sample.message").alias("sample_message"), F.col("sample.trace_id").alias("sample_trace"))


@query
def spikes(spark, d):
    return _clusters(spark, d).where("spike").select(
        "request_id", "evidence_id", "exception_class", "message_template", "current_count", "baseline_count", "last_seen")


@query
def cluster_ids(spark, d):
    return _clusters(spark, d).select("request_id", "evidence_id", "cluster_key", "first_seq")


def _candidates(df: DataFrame) -> DataFrame:
    return df.select("request_id", "label", "title", "strength", _list("evidence_ids").alias("evidence_ids"))


@query
def deployment_regression(spark, d):
    asked = _asked(spark, d)
    return _candidates(J.deployment_regression(
        _changes(spark, d, asked), _clusters(spark, d, asked), back=SETTINGS.deploy_back, forward=SETTINGS.deploy_forward))


@query
def pool_contention(spark, d):
    return _candidates(J.pool_contention(_slow_sql(spark, d), _metrics(spark, d), window=SETTINGS.sql_window))


@query
def latency_correlation(spark, d):
    return _candidates(J.latency_correlation(_slow_sql(spark, d), _metrics(spark, d), window=SETTINGS.sql_window))


@query
def trace_links(spark, d):
    """Slow statements and the errors they belong to: same trace, request, module, or time alone."""
    statements, errors = E.traced_events(spark, d, "view", "stmt-"), E.traced_events(spark, d, "error", "log-")
    return W.link_evidence(statements, errors, W.tiers(HOUR))


# --- budget, evidence, timeline -----------------------------------------------------------------

def _ranked(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("request_id", "evidence_id", *columns, F.col("rank_no").cast("long").alias("rank_no"))


@query
def budget_logs(spark, d):
    return _ranked(B.keep_clusters(_clusters(spark, d), TIGHT[0]), "count", "spike")


@query
def budget_slow_sql(spark, d):
    return _ranked(B.keep_slow_sql(_slow_sql(spark, d), TIGHT[1]), "avg_duration_ms")


@query
def budget_metrics(spark, d):
    return _ranked(B.keep_metrics(_metrics(spark, d)), "metric")


@query
def budget_changes(spark, d):
    return _ranked(B.keep_changes(_changes(spark, d), TIGHT[3]), "type")


@query
def asked_clusters(spark, d):
    rows = Q.keep_asked_clusters(E.asked_requests(spark, d), _clusters(spark, d), _changes(spark, d), TIGHT[0])
    return _ranked(rows, "question_hits", "level", "count", "deployment_gap_us")


@query
def asked_slow_sql(spark, d):
    rows = Q.keep_asked_slow_sql(E.asked_requests(spark, d), _slow_sql(spark, d), _changes(spark, d), TIGHT[1])
    return _ranked(rows, "question_hits", "avg_duration_ms", "deployment_gap_us")


@query
def budget_report(spark, d):
    projects = E.projects(spark, d)
    asked = materialize(A.accepted_requests(E.requests(spark, d), projects))
    # counts need no texts, so the plans of all kinds but the clusters are read without them
    return B.budget_report(asked, *[f(spark, d, asked) for f in (_clusters, _slow_sql, _metrics, _changes)], SETTINGS.caps)


@query
def evidence_text(spark, d):
    unranked, asked = F.lit(0).alias("rank_no"), _asked(spark, d)
    tables = [f(spark, d, asked).select("*", unranked) for f in (_clusters, _metrics, _slow_sql, _changes)]
    return T.evidence_rows(*tables, _health(spark, d, asked)).select("request_id", "evidence_id", "type", "description")


@query
def evidence(spark, d):
    asked = _asked(spark, d)
    kept = (
        B.keep_clusters(_clusters(spark, d, asked)), B.keep_metrics(_metrics(spark, d, asked)),
        B.keep_slow_sql(_slow_sql(spark, d, asked)), B.keep_changes(_changes(spark, d, asked)))
    return T.evidence_rows(*kept).select(
        "request_id", "evidence_id", "type", "description", F.col("rank_no").cast("long").alias("rank_no"))


@query
def timeline(spark, d):
    asked = _asked(spark, d)
    tables = [f(spark, d, asked) for f in (_changes, _clusters, _metrics, _slow_sql, _health)]
    entries = T.timeline_entries(*tables)
    return T.order_timeline(entries).select("request_id", "position", "at", "category", "description", "evidence_id")


@query
def timeline_integrity(spark, d):
    run = diagnosis(spark, d, Settings(**{**SETTINGS.__dict__, "caps": TIGHT}))
    entries = T.timeline_entries(run.changes, run.clusters, run.metrics, run.slow_sql, run.health)
    return I.resolved_timeline(entries, run.evidence).select("request_id", "at", "category", "evidence_id")


@query
def candidate_integrity(spark, d):
    run = diagnosis(spark, d, Settings(**{**SETTINGS.__dict__, "caps": TIGHT}))
    return _candidates(run.candidates)


@query
def evidence_audit(spark, d):
    return U.evidence_audit(diagnosis(spark, d).evidence, "evidence_id", "type", "description")


# --- reports ------------------------------------------------------------------------------------

@query
def model_inputs(spark, d):
    return diagnosis(spark, d).model_inputs()


@query
def parse_model_output(spark, d):
    parsed = P.parse_model_outputs(E.model_outputs(spark, d))
    of = lambda name: _list(F.transform("model_candidates", lambda c: F.coalesce(c[name], F.lit("")))).alias(name + "s")
    ids = F.transform("model_candidates", lambda c: F.array_join(F.coalesce(c["evidenceIds"], F.array().cast("array<string>")), ","))
    return parsed.select(
        "request_id", "valid", "summary", of("label"), of("explanation"), _list(ids).alias("evidence_ids"),
        _list("recommended_actions").alias("actions"))


@query
def merge_explanations(spark, d):
    merged = P.merge_explanations(diagnosis(spark, d).candidates, P.parse_model_outputs(E.request_answers(spark, d)))
    return merged.select("request_id", "label", "explanation")


@query
def narrate(spark, d):
    told = diagnosis(spark, d).narration()
    explanations = F.transform("model_candidates", lambda c: c["explanation"])
    return told.select("request_id", "summary", _list(explanations).alias("explanations"), _list("recommended_actions").alias("actions"))


@query
def assign_report_ids(spark, d):
    turns = E.submitted_requests(spark, d).select("request_id")
    stored = E.table(spark, d, "conversations").where(F.col("conv_id") % 3 == 1).select(
        P.report_id(REPORT_DAY, F.col("conv_id")).alias("diagnosis_id")).distinct()
    return P.assign_report_ids(turns, [F.col("request_id").asc_nulls_last()], stored, REPORT_DAY)


def _flat_report(reports: DataFrame) -> DataFrame:
    def names(column: str, field: str) -> Column:
        return _list(F.transform(column, lambda x: x[field]))

    return reports.select(
        "request_id", "project_id", "environment", "summary", "rule_fallback",
        names("timeline", "evidence_id").alias("timeline_ids"),
        names("root_cause_candidates", "label").alias("labels"),
        _list(F.transform("root_cause_candidates", lambda c: F.coalesce(c["explanation"], F.lit("")))).alias("explanations"),
        _list("recommended_actions").alias("actions"), names("evidence", "evidence_id").alias("evidence_ids"),
        _list("unavailable_sources").alias("unavailable"), "disclaimer",
        *[F.col(f"budget.{c}").alias(c) for c in ("log_clusters_kept", "metrics_truncated", "any_truncated")])


@query
def reports(spark, d):
    return _flat_report(diagnosis(spark, d).reports())


@query
def fallback_reports(spark, d):
    answers = P.parse_model_outputs(E.request_answers(spark, d))
    return _flat_report(diagnosis(spark, d).reports(answers))


@query
def stored_reports_roundtrip(spark, d):
    """Diagnose, finish, append, read back: every stored report."""
    path = scratch_path(spark, "reports")
    O.append_reports(diagnosis(spark, d).finished(instant("2024-02-01 00:00:00"), REPORT_DAY), path)
    return O.report_heads(O.latest_reports(O.read_reports(spark, path)))


# --- end to end and scoring ---------------------------------------------------------------------

@query
def diagnose_candidates(spark, d):
    return _candidates(diagnosis(spark, d).candidates)


@query
def diagnose_evidence(spark, d):
    return diagnosis(spark, d).evidence.select("request_id", "evidence_id", "type", "description")


@query
def diagnose_timeline(spark, d):
    return diagnosis(spark, d).timeline.select(
        "request_id", F.col("position").cast("long").alias("position"), "at", "category", "description", "evidence_id")


@query
def score_reports(spark, d):
    return V.score_reports(*E.scored_tables(spark, d))


@query
def score_summary(spark, d):
    return V.score_summary(V.score_reports(*E.scored_tables(spark, d)))
