"""The given Parquet tables read as evidence tables.

Each function only declares a plan; plans are kept per session and folder, data is not.
``events`` becomes logs, change events, metric anomalies and slow SQL; ``orders`` becomes captured
database sessions; ``conversations`` becomes stored reports and model answers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.functions.text import exception_attributes
from incidentlens.schemas import conform, LOG_EVENTS
from incidentlens.session import instant

RANGE_FROM = "2024-01-28 00:00:00"
RANGE_TO = "2024-01-30 00:00:00"


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def _month(ts: str) -> Column:
    return F.substring(F.to_date(ts).cast("string"), 1, 7)


@lru_cache(maxsize=32)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scoped(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("project_id", _text("svc-", (F.col(key) % 5).cast("string"))).withColumn(
        "environment", F.when(F.col(key) % 2 == 0, "local").otherwise("staging")
    )


@lru_cache(maxsize=32)
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _scoped(table(spark, sf_dir, "events"), "user_id")
    return raw.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@lru_cache(maxsize=32)
def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows before the exception class is derived."""
    kind, mod = F.col("event_type"), (F.col("k") % 3)
    name = F.when(mod == 0, "NullPointer").when(mod == 1, "IllegalState").otherwise("IllegalArgument")
    stack = _text(
        "java.lang.", name, "Exception: k=", _s("k"),
        "\n\tat com.example.S", mod.cast("string"), ".run(S.java:", _s("event_id"), ")",
    )
    # only errors have a stack to name k in, so only their JSON is read
    return events(spark, sf_dir).withColumn("k", F.when(kind == "error", F.col("k"))).select(
        "project_id", "environment", F.col("ts").alias("occurred_at"),
        F.when(kind == "error", "ERROR").when(kind == "view", "WARN").when(kind == "click", "warn")
        .otherwise("INFO").alias("level"),
        _text("com.example.", kind).alias("logger"),
        _text("t-", _s("event_id")).alias("trace_id"),
        _text(
            kind, " order ", _s("event_id"), " failed for user ", _s("user_id"), " from 10.0.",
            (F.col("user_id") % 256).cast("string"), ".7 token=abc", _s("event_id"),
        ).alias("message"),
        F.when(kind == "error", stack).alias("stack_trace"),
        F.col("event_id").alias("arrival_seq"),
    )


@lru_cache(maxsize=32)
def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = raw_logs(spark, sf_dir)
    return conform(logs.withColumn("attributes", exception_attributes(F.col("stack_trace"))), LOG_EVENTS)


@lru_cache(maxsize=32)
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    mod = F.col("event_id") % 3
    return events(spark, sf_dir).where(F.col("event_type") == "signup").select(
        _text("event-", _s("event_id")).alias("evidence_id"), "project_id", "environment",
        F.when(mod == 0, "DEPLOYMENT").when(mod == 1, "ROLLBACK").otherwise("CONFIG_CHANGE").alias("type"),
        F.col("ts").alias("occurred_at"),
        F.create_map(
            F.lit("version"), _text("v", _s("k")), F.lit("password"), _text("pw", _s("event_id"))
        ).alias("attributes"),
        F.col("event_id").alias("change_seq"),
    )


@lru_cache(maxsize=32)
def metric_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    mod = F.col("event_id") % 8
    metric = (
        F.when(mod == 0, "db_pool_pending_connections").when(mod == 1, "http_p95_seconds")
        .when(mod == 2, "request_latency_ms").otherwise("cpu_usage_percent")
    )
    return events(spark, sf_dir).where(F.col("event_type") == "purchase").select(
        _text("metric-", _s("event_id")).alias("evidence_id"), "project_id", "environment",
        metric.alias("metric"),
        _text(metric, " rose for user", _s("user_id"), "@example.com secret=", _s("event_id")).alias("description"),
        F.col("value").alias("baseline_value"), (F.col("value") * 3).alias("current_value"),
        F.lit("count").alias("unit"), F.col("ts").alias("observed_at"),
        F.col("event_id").alias("metric_seq"),
    )


@lru_cache(maxsize=32)
def raw_slow_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("event_type") == "view").select(
        "project_id", "environment",
        _text("select * from t_", (F.col("user_id") % 3).cast("string"), " where id = ?").alias("sql_template"),
        F.round(F.col("value") * 10).cast("long").alias("duration_ms"),
        F.col("ts").alias("occurred_at"),
    )


def traced_events(spark: SparkSession, sf_dir: str, kind: str, prefix: str) -> DataFrame:
    """Events of a kind as evidence that may carry a trace, a request and a module.

    A quarter has no trace, a fifth no address; traces are short runs of a user's events.
    """
    n, user = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).where(F.col("event_type") == kind).select(
        _text(prefix, _s("event_id")).alias("evidence_id"), "project_id", "environment", F.col("ts").alias("occurred_at"),
        F.when(n % 4 != 0, _text("t-", _s("user_id"), "-", (n % 11).cast("string"))).alias("trace_id"),
        F.when(n % 5 != 0, _text("/api/", (user % 7).cast("string"))).alias("request_uri"),
        _text("t_", (user % 3).cast("string")).alias("sql_source"),
        _text("m", (F.col("k") % 4).cast("string")).alias("module"),
        F.when(n % 3 != 0, _text("E", (F.col("k") % 3).cast("string"))).alias("exception_class"),
    )


def asked_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests with questions that name an exception, a table, or nothing that stands in the evidence."""
    day = F.expr("day(from_ts) DIV 2 % 4")
    subject = F.when(day == 0, "IllegalStateException").when(day == 1, "rows of T_1").when(day == 2, "the view order").otherwise("it")
    return requests(spark, sf_dir).withColumn(
        "question", _text("Why does ", subject, " break in ", F.col("project_id"), "? password=", F.col("environment")))


@lru_cache(maxsize=32)
def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per project seen in the events, with the sources it uses."""
    number = F.substring("project_id", 5, 9).cast("int")
    return (
        events(spark, sf_dir).groupBy("project_id")
        .agg(F.array_sort(F.collect_set("environment")).alias("environments"))
        .select(
            "project_id", _text("Service ", F.col("project_id")).alias("display_name"), "environments",
            F.lit(48).alias("max_query_hours"), F.lit(25).alias("max_results"),
            F.when(number == 0, "mock").when(number == 1, "local-file").when(number == 2, "jdbc")
            .when(number == 4, "syslog").alias("logs_type"),
            F.when(number == 1, "mysql").when(number == 2, "PostgreSQL").when(number == 3, "  ")
            .when(number == 4, "mysql").alias("database_type"),
        )
    )


@lru_cache(maxsize=32)
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each project and environment over the whole time of its events.

    Two days each, end to end, and one of twenty hours (shorter than the current window) every
    six days that overlaps them. Limits differ by day.
    """
    span = events(spark, sf_dir).groupBy("project_id", "environment").agg(
        F.to_date(F.min("ts")).alias("low"), F.to_date(F.max("ts")).alias("high"))

    def every(days: int, offset_hours: int, hours: int) -> DataFrame:
        day = F.explode(F.sequence("low", "high", F.expr(f"INTERVAL '{days}' DAY"))).alias("day")
        start = F.col("day").cast("timestamp_ntz") + F.expr(f"INTERVAL '{offset_hours}' HOUR")
        return span.select("project_id", "environment", day).select(
            _text("req-", F.col("project_id"), "-", F.col("environment"), "-", F.date_format("day", "yyyyMMdd"), f"-{hours}h").alias("request_id"),
            "project_id", "environment",
            _text("why did ", F.col("project_id"), " fail? password=", F.col("environment")).alias("question"),
            start.alias("from_ts"), (start + F.expr(f"INTERVAL '{hours}' HOUR")).alias("to_ts"),
            (F.dayofmonth("day") % 3 * 15 + 10).cast("int").alias("max_results"),
        )

    return every(2, 0, 48).unionByName(every(6, 5, 20))


def submitted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a submitted request; some of them invalid."""
    seconds = F.expr("make_dt_interval(0, CAST(conv_id % 50 AS INT), 0, CAST(turn AS INT))")
    start = instant(RANGE_FROM)
    mod = F.col("conv_id") % 11
    return table(spark, sf_dir, "conversations").select(
        _text("ask-", _s("conv_id"), "-", _s("turn"), "-", F.col("role")).alias("request_id"),
        F.when(mod == 0, "svc-unknown").when(mod == 1, " ")
        .otherwise(_text("svc-", (F.col("conv_id") % 5).cast("string"))).alias("project_id"),
        F.when(mod == 2, "moon").when(F.col("turn") % 2 == 0, "local").otherwise("staging").alias("environment"),
        F.when(mod == 3, F.lit("  ")).otherwise(
            _text(F.col("text"), " token=", _s("conv_id"))
        ).alias("question"),
        start.alias("from_ts"), (start + seconds).alias("to_ts"), F.lit(25).alias("max_results"),
    )


def submitted_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events as they are posted, in posting order; some of them invalid."""
    mod = F.col("k") % 13
    return events(spark, sf_dir).where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("received_seq"),
        F.when(mod == 0, "svc-unknown").otherwise(F.col("project_id")).alias("project_id"),
        F.when(mod == 1, "moon").otherwise(F.col("environment")).alias("environment"),
        F.when(mod == 2, "  ").otherwise("DEPLOYMENT").alias("type"),
        F.when(mod != 3, F.col("ts")).alias("occurred_at"),
        F.when(
            mod == 4, F.create_map(F.lit("commit"), F.lit(None).cast("string"))
        ).when(mod == 5, F.lit(None)).otherwise(F.create_map(
            F.lit("api_key"), _text("key", _s("event_id")),
            F.lit("note"), _text("by user", _s("user_id"), "@example.com"),
            F.lit("version"), _text("v", _s("k")),
        )).alias("attributes"),
    )


def posted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups and clicks as posted in batches of up to eight neighbours of one project and environment; some invalid, some repeated."""
    number = F.expr("event_id DIV 40")
    mod = F.col("received_seq") % 11
    in_order = F.sort_array(F.collect_list(F.struct(
        F.col("event_id").alias("seq"), F.upper("event_type").alias("type"), F.col("ts").alias("occurred_at"), "k")))
    events_of = F.transform(in_order, lambda e: F.struct(
        e["type"].alias("type"), e["occurred_at"].alias("occurred_at"),
        F.create_map(F.lit("version"), _text("v", e["k"].cast("string"))).alias("attributes"),
        F.when(e["k"] == 77, F.lit(20_000)).otherwise(100 + e["k"]).cast("long").alias("bytes")))
    posts = (
        events(spark, sf_dir).where(F.col("event_type").isin("signup", "click"))
        .groupBy(number.alias("number"), "project_id", "environment").agg(events_of.alias("events"), F.max("ts").alias("received_at"))
        .withColumn("received_seq", F.col("number") * 10 + F.substring("project_id", 5, 9).cast("int") * 2 + (F.col("environment") == "local").cast("int"))
    )
    own = F.when(mod == 3, "svc-9").otherwise(F.col("project_id"))
    return posts.select(
        "received_seq", F.when(mod == 1, F.lit(" ")).otherwise(_text("post-", F.col("project_id"), "-", F.expr("number DIV 2").cast("string"))).alias("request_id"),
        (F.col("received_at") - F.when(mod == 2, F.expr("INTERVAL '301' SECOND")).otherwise(F.expr("INTERVAL '300' SECOND"))).alias("sent_at"),
        "received_at", own.alias("token_project"),
        F.when(mod == 4, F.array(F.lit("moon"))).otherwise(F.array(F.lit("local"), F.lit("staging"))).alias("token_environments"),
        "project_id", "environment", "events",
    )


@lru_cache(maxsize=32)
def pg_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured database sessions: one snapshot per project, environment and month, some after the last request."""
    month = F.expr("make_timestamp_ntz(year(o_orderdate) + 26, month(o_orderdate), 1, 0, 0, 0)")
    age = F.expr("make_dt_interval(0, 0, 0, CAST(o_orderkey % 61 AS INT))")
    status = F.col("o_orderstatus")
    return _scoped(table(spark, sf_dir, "orders"), "o_custkey").select(
        "project_id", "environment",
        _text(F.col("project_id"), "/", F.col("environment"), "/", _month("o_orderdate")).alias("snapshot_id"),
        (month + F.expr("INTERVAL '60' SECOND")).alias("captured_at"),
        F.col("o_orderkey").alias("pid"),
        F.when(status == "O", "active").when(status == "F", "idle").otherwise("idle in transaction").alias("state"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Lock").alias("wait_event_type"),
        F.when(F.col("o_orderkey") % 7 != 0, month + age).alias("xact_start"),
        _text("update stock set token=", _s("o_custkey"), " where id = ", _s("o_orderkey")).alias("query"),
    )


@lru_cache(maxsize=32)
def pg_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured locks of the same snapshots."""
    return _scoped(table(spark, sf_dir, "orders"), "o_custkey").select(
        "project_id", _text(F.col("project_id"), "/", F.col("environment"), "/", _month("o_orderdate")).alias("snapshot_id"),
        F.col("o_orderkey").alias("pid"), F.lit("tuple").alias("locktype"),
        _text("password=", F.col("o_orderpriority")).alias("mode"),
        (F.col("o_orderstatus") != "P").alias("granted"),
    )


def mysql_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured server status values: one snapshot per project, environment and day."""
    mod = F.col("event_id") % 4
    return events(spark, sf_dir).select(
        "project_id", "environment",
        _text(F.col("project_id"), "/", F.col("environment"), "/", F.to_date("ts").cast("string")).alias("snapshot_id"),
        F.to_date("ts").cast("timestamp_ntz").alias("captured_at"),
        F.when(mod == 0, "Threads_connected").when(mod == 1, "THREADS_RUNNING").when(mod == 2, "Uptime")
        .otherwise("Version").alias("name"),
        F.when(F.col("k") % 10 == 3, "n/a").otherwise(_s("k")).alias("value"),
    )


def mysql_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg_activity(spark, sf_dir).where(F.col("xact_start").isNotNull()).select(
        "project_id", "snapshot_id", "captured_at", F.col("pid").alias("trx_id"),
        F.col("xact_start").alias("trx_started"), F.col("query").alias("trx_query"),
    )


def mysql_lock_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg_locks(spark, sf_dir).where(~F.col("granted")).select(
        "project_id", "snapshot_id", F.col("pid").alias("blocking_id"), (F.col("pid") + 1).alias("requesting_id")
    )


def mysql_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement digests with durations in picoseconds; some rows have no digest text."""
    hundredths = F.round(F.col("value") * 100).cast("long")
    return (
        events(spark, sf_dir).withColumn("bucket", F.col("k") % 20)
        .groupBy("project_id", "environment", "event_type", "bucket")
        .agg(
            F.count("*").alias("count_star"),
            F.expr("CAST(sum(CAST(round(value * 100) AS BIGINT)) * 100000000 DIV count(*) AS BIGINT)").alias("avg_timer_wait"),
            (F.max(hundredths) * 100000000).alias("max_timer_wait"),
        )
        .withColumn("digest_text", F.when(F.col("event_type") != "signup", _text(
            "SELECT ", F.col("event_type"), " FROM t WHERE k = ", _s("bucket"))))
        .drop("event_type", "bucket")
    )


def pg_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statements with mean and maximum in milliseconds."""
    return mysql_digests(spark, sf_dir).select(
        "project_id", "environment", F.col("digest_text").alias("query"), F.col("count_star").alias("calls"),
        (F.col("avg_timer_wait") / F.lit(1e9)).alias("mean_exec_time"),
        (F.col("max_timer_wait") / F.lit(1e9)).alias("max_exec_time"),
    )


def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each evidence source reported; the state names ``k`` once, since a filter on it reads the JSON of every event."""
    kind, mod = F.col("event_type"), F.col("k") % 6
    states = F.array(*[F.lit(state) for state in ("timeout", "error", "rejected")])
    return events(spark, sf_dir).select(
        "project_id", "environment",
        F.when(kind == "error", "log").when(kind == "purchase", "metric").when(kind == "view", "slow-sql")
        .when(kind == "signup", "change-event").otherwise("db-health").alias("kind"),
        _text("Source", mod.cast("string")).alias("name"),
        F.coalesce(F.get(states, mod), F.lit("ok")).alias("state"),
    ).distinct()


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw model answer per conversation turn; a fixed share of them is unusable."""
    n = F.col("conv_id") + F.col("turn")
    ident = _text(_s("conv_id"), "-", _s("turn"))
    good = _text(
        '{"summary":"answer ', ident, '","rootCauseCandidates":[{"label":"deployment-regression",'
        '"title":"t","explanation":"because ', ident, '","evidenceIds":["log-', _s("turn"), '",7]},'
        '{"label":" ","explanation":"dropped"},{"label":"slow-sql-pool-contention","explanation":" "},'
        '{"label":"deployment-regression","explanation":"second"}],'
        '"recommendedActions":["check ', ident, '","review"]}',
    )
    mod = n % 9
    return table(spark, sf_dir, "conversations").select(
        ident.alias("request_id"), "conv_id", "turn",
        F.when(mod == 0, "").when(mod == 1, "{ broken").when(mod == 2, '"string"').when(mod == 3, "[1,2,3]")
        .when(mod == 4, '{"unrelated":true}').when(mod == 5, '{"summary":5}')
        .when(mod == 6, _text('{"summary":"only ', ident, '"}')).otherwise(good).alias("raw_json"),
    )


def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as one stored version of its conversation's report; some JSON is corrupt."""
    minutes = F.expr("make_dt_interval(0, 0, CAST(conv_id AS INT), CAST(turn AS INT))")
    scoped = _scoped(table(spark, sf_dir, "conversations"), "conv_id")
    ident = _text("diag-", _s("conv_id"))
    body = _text(
        '{"diagnosisId":"', ident, '","projectId":"', F.col("project_id"), '","environment":"',
        F.col("environment"), '","summary":"version ', _s("turn"), '","ruleFallback":',
        F.when(F.col("turn") % 2 == 0, "true").otherwise("false"), "}",
    )
    return scoped.select(
        ident.alias("diagnosis_id"), "project_id", "environment", F.col("turn").alias("version"),
        (instant(RANGE_FROM) + minutes).alias("created_at"),
        F.when(F.col("conv_id") % 7 == 3, F.lit('{"diagnosisId":')).otherwise(body).alias("report_json"),
    )


def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model answer per request of :func:`requests`; some missing, some unusable."""
    number = F.substring("project_id", 5, 9).cast("int")
    head = _text('{"summary":"answer for ', F.col("request_id"), '","rootCauseCandidates":[')
    first = '{"label":"deployment-regression","explanation":"'
    second = '{"label":"slow-sql-pool-contention","explanation":"pool told"},{"label":"invented","explanation":"x"}'
    tail = '],"recommendedActions":["step one","step two"]}'
    raw = (
        F.when(number == 0, F.lit("{ broken"))
        .when(number == 1, _text(head, first, 'deploy told"},', second, tail))
        .when(number == 2, _text(head, tail))
        .otherwise(_text(head, first, ' "},', first, 'told later"},', second, tail))
    )
    return requests(spark, sf_dir).where(F.col("project_id") != "svc-4").select("request_id", raw.alias("raw_json"))


def health_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of every snapshot of the projects' own kind of database; one project's did not answer.

    Findings are counted for the snapshots of those projects only, the others would meet no snapshot.
    """
    from incidentlens.sources import database as D

    number = F.col("project_id")

    def of(source: Callable[[SparkSession, str], DataFrame], *owners: str) -> DataFrame:
        return source(spark, sf_dir).where(number.isin(*owners))

    pg = D.with_findings(D.pg_health(of(pg_activity, "svc-2")), lock_waits=D.pg_lock_waits(of(pg_locks, "svc-2")))
    mysql = D.with_findings(
        D.mysql_health(of(mysql_status, "svc-1", "svc-4")),
        long_transactions=D.mysql_long_transactions(of(mysql_transactions, "svc-1", "svc-4")),
        lock_waits=D.mysql_lock_waits(of(mysql_lock_waits, "svc-1", "svc-4")))
    return pg.unionByName(mysql).withColumn("available", number != "svc-1")


def daily_slow_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow SQL summaries per template and day."""
    from incidentlens.sources.evidence import rollup_slow_sql

    raw = raw_slow_sql(spark, sf_dir)
    return rollup_slow_sql(raw.withColumn("day", F.to_date("occurred_at")), "day").drop("day")


# --- reports to score, from conversations -------------------------------------------------------

def scenario_label(number: Column) -> Column:
    return (
        F.when(number % 3 == 0, "deployment-regression").when(number % 3 == 1, "slow-sql-pool-contention")
        .otherwise("slow-sql-latency-correlation")
    )


def scored_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Scenarios, reports, candidates and evidence: one report per conversation."""
    turns = table(spark, sf_dir, "conversations")
    ids = turns.select("conv_id").distinct()
    report_id = F.col("conv_id").alias("report_id")
    scenarios = ids.select(
        report_id, scenario_label(F.col("conv_id")).alias("expected_label"),
        F.array(F.lit("log-1"), _text("sql-", (F.col("conv_id") % 3).cast("string"))).alias("required_ids"))
    reports = ids.select(
        report_id, F.when(F.col("conv_id") % 7 == 0, " ").otherwise(_text("summary ", _s("conv_id"))).alias("summary"),
        (F.col("conv_id") % 5 == 0).alias("rule_fallback"))
    candidates = turns.where(F.col("role") == "assistant").select(
        report_id, scenario_label(F.col("turn") + F.col("conv_id") - 1).alias("label"),
        F.array(_text("log-", _s("turn")), _text("sql-", (F.col("conv_id") % 3).cast("string"))).alias("evidence_ids"))
    cited = turns.where(F.col("role") == "user").select(
        report_id, F.explode(F.array(
            _text("log-", (F.col("turn") + 1).cast("string")), _text("sql-", (F.col("conv_id") % 4).cast("string"))
        )).alias("evidence_id"))
    return scenarios, reports, candidates, cited
