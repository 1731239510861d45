"""Captured database views: slow statements, sessions, transactions and locks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens.functions.rules import joined
from incidentlens.functions.text import not_blank, redact
from incidentlens.operators.asof import latest_before
from incidentlens.operators.ranking import largest, top_n
from incidentlens.session import broadcast_if_small, interval


def _whole_ms(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")


def database_kind(database_type: Column) -> Column:
    """``mysql``, ``postgresql`` or null for a project without a database."""
    kind = F.lower(database_type)
    known = F.when(kind == "postgres", "postgresql").otherwise(kind)
    return F.when(not_blank(database_type), known)


def _ranked_statements(requests: DataFrame, statements: DataFrame, n: int | str, source: str) -> DataFrame:
    """Statements are ranked once per project and environment, down to the largest limit any of
    its requests has, and only the winners meet the requests. ``n`` is a number or the request's
    column that holds it."""
    place = ["project_id", "environment"]
    limit = F.col(n) if isinstance(n, str) else F.lit(n)
    asked = requests.select("request_id", *place, "from_ts", limit.cast("int").alias("_n"))
    known = statements.where(F.col("sql_template").isNotNull())
    order = [F.desc("_avg"), F.col("sql_template")]
    if isinstance(n, int):
        winners = top_n(known, place, order, n)
    else:
        limits = asked.groupBy(*place).agg(F.max("_n").alias("_most"))
        winners = top_n(
            known.join(limits, place), place, order, F.col("_most"), most=largest(asked, F.col("_n"))).drop("_most")
    ranked = winners.join(asked, place).where(F.col("rank_no") <= F.col("_n"))
    return ranked.select(
        "request_id", F.concat(F.lit("dbsql-"), F.col("rank_no").cast("string")).alias("evidence_id"),
        "project_id", "environment", "sql_template", "occurrences",
        _whole_ms(F.col("_avg")).alias("avg_duration_ms"), _whole_ms(F.col("_max")).alias("max_duration_ms"),
        F.col("from_ts").alias("first_seen"), F.lit(source).alias("source"),
        F.col("rank_no").cast("long").alias("sql_seq"),
    )


def mysql_digest(requests: DataFrame, digests: DataFrame, n: int | str = "max_results") -> DataFrame:
    """Slowest statement digests per request; durations come in picoseconds. No time filter."""
    rows = digests.select(
        "project_id", "environment", F.col("digest_text").alias("sql_template"),
        F.col("count_star").alias("occurrences"),
        (F.col("avg_timer_wait") / F.lit(1e9)).alias("_avg"), (F.col("max_timer_wait") / F.lit(1e9)).alias("_max"),
    )
    return _ranked_statements(requests, rows, n, "mysql-digest")


def pg_statements(requests: DataFrame, statements: DataFrame, n: int | str = "max_results") -> DataFrame:
    """The same from statement statistics that are already in milliseconds."""
    rows = statements.select(
        "project_id", "environment", F.col("query").alias("sql_template"), F.col("calls").alias("occurrences"),
        F.col("mean_exec_time").alias("_avg"), F.col("max_exec_time").alias("_max"),
    )
    return _ranked_statements(requests, rows, n, "pg_stat_statements")


def route_slow_sql(projects: DataFrame, database_rows: DataFrame, fallback_rows: DataFrame) -> DataFrame:
    """Database digests for projects with a database, the fallback source for all others."""
    with_database = broadcast_if_small(projects.where(not_blank(F.col("database_type"))).select("project_id"))
    return database_rows.join(with_database, "project_id", "left_semi").unionByName(
        fallback_rows.join(with_database, "project_id", "left_anti"))


# --- health -------------------------------------------------------------------------------------

def mysql_health(status: DataFrame) -> DataFrame:
    """Connections per snapshot from server status values; only all-digit values count."""
    # the check stands in the column and not in a filter, which would work the value out twice
    numeric = status.select(
        "project_id", "environment", "snapshot_id", "captured_at", F.lower("name").alias("name"),
        F.when(F.col("value").rlike(r"\A[0-9]+\z"), F.col("value").cast("long")).alias("value"))

    def value_of(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("name") == name, F.col("value"))), F.lit(0))

    counted = numeric.groupBy("project_id", "environment", "snapshot_id", "captured_at").agg(
        value_of("threads_running").alias("active_connections"), value_of("threads_connected").alias("_connected"),
        F.count("value").alias("_numbers")).where("_numbers > 0")
    return counted.select(
        "project_id", "environment", "snapshot_id", "captured_at", "active_connections",
        F.greatest(F.lit(0).cast("long"), F.col("_connected") - F.col("active_connections")).alias("idle_connections"),
        F.lit(0).cast("long").alias("waiting_connections"), F.lit(0).cast("long").alias("long_transactions"),
    )


def pg_health(activity: DataFrame, threshold: float = C.LONG_TRANSACTION_SECONDS) -> DataFrame:
    """Active, idle and waiting sessions and long transactions per snapshot in one pass."""
    active = F.col("state") == "active"
    return activity.groupBy("project_id", "environment", "snapshot_id", "captured_at").agg(
        F.count_if(active).alias("active_connections"),
        F.count_if(F.col("state") == "idle").alias("idle_connections"),
        F.count_if(active & F.col("wait_event_type").isNotNull()).alias("waiting_connections"),
        F.count_if(F.col("captured_at") - F.col("xact_start") > interval(threshold)).alias("long_transactions"),
    )


def _age_text(age_seconds: Column) -> Column:
    def two(value: Column) -> Column:
        return F.lpad(value.cast("string"), 2, "0")

    hours = F.floor(age_seconds / 3600)
    hour_text = F.when(hours < 10, two(hours)).otherwise(hours.cast("string"))
    return F.concat(hour_text, F.lit(":"), two(F.floor(age_seconds / 60) % 60), F.lit(":"), two(age_seconds % 60))


def pg_long_transactions(activity: DataFrame, threshold: float = C.LONG_TRANSACTION_SECONDS) -> DataFrame:
    """One redacted text per transaction strictly older than the threshold at capture time."""
    age = F.col("captured_at") - F.col("xact_start")
    seconds = age.cast("interval second").cast("decimal(20,6)").cast("long")
    return activity.where(age > interval(threshold)).select(
        "snapshot_id", F.lit("postgresql").alias("engine"),
        redact(joined("pid=", F.col("pid"), " age=", _age_text(seconds), " query=", F.col("query"))).alias("entry"),
    )


def mysql_long_transactions(transactions: DataFrame, threshold: float = C.LONG_TRANSACTION_SECONDS) -> DataFrame:
    return transactions.where(F.col("trx_started") < F.col("captured_at") - interval(threshold)).select(
        "snapshot_id", F.lit("mysql").alias("engine"),
        redact(joined(
            "trx=", F.col("trx_id"), " started=", F.date_format("trx_started", "yyyy-MM-dd HH:mm:ss"),
            " query=", F.col("trx_query"))).alias("entry"),
    )


def pg_lock_waits(locks: DataFrame) -> DataFrame:
    return locks.where(~F.col("granted")).select(
        "snapshot_id", F.lit("postgresql").alias("engine"),
        redact(joined("pid=", F.col("pid"), " locktype=", F.col("locktype"), " mode=", F.col("mode"))).alias("entry"),
    )


def mysql_lock_waits(waits: DataFrame) -> DataFrame:
    return waits.select(
        "snapshot_id", F.lit("mysql").alias("engine"),
        redact(joined("blocking=", F.col("blocking_id"), " waiting=", F.col("requesting_id"))).alias("entry"),
    )


def with_findings(health: DataFrame, **findings: DataFrame) -> DataFrame:
    """Snapshots with the numbers of their findings, e.g. ``lock_waits=rows``."""
    counted = health
    for name, rows in findings.items():
        numbers = rows.groupBy("snapshot_id").agg(F.count("*").alias(name))
        counted = counted.drop(name).join(numbers, "snapshot_id", "left").fillna(0, [name])
    return counted.withColumns({"available": F.lit(True), "unavailable_reason": F.lit(None).cast("string")})


def health_status(requests: DataFrame, projects: DataFrame, snapshots: DataFrame, max_age: float | None = None) -> DataFrame:
    """Newest snapshot per request as of its end, or why there is none.

    Only snapshots captured up to the request's end count; ``max_age`` seconds, if given, bounds how old
    one may be. A project without a database is a sentinel and is dropped; a database without such
    a snapshot is unavailable, which is kept and counted; an unknown kind of database is an error.
    """
    kinds = projects.select("project_id", database_kind(F.col("database_type")).alias("_kind"))
    ranged = requests.select("request_id", "project_id", "environment", "from_ts", "to_ts")
    newest = latest_before(ranged, snapshots, ["project_id", "environment"], "request_id", "to_ts", "captured_at", "snapshot_id")
    if max_age is not None:
        ends = ranged.select("request_id", F.col("to_ts").alias("_end"))
        newest = newest.join(ends, "request_id").where(F.col("captured_at") >= F.col("_end") - interval(max_age)).drop("_end")
    chosen = newest.join(snapshots, ["project_id", "environment", "snapshot_id", "captured_at"])
    joined_rows = ranged.join(kinds, "project_id", "left").join(
        chosen.drop("project_id", "environment"), "request_id", "left")
    found = F.coalesce("available", F.lit(False))
    product = (
        F.when(F.col("_kind") == "mysql", "MySQL unavailable").when(F.col("_kind") == "postgresql", "PostgreSQL unavailable")
        .otherwise(F.concat(F.lit("unsupported database "), "_kind")))
    reason = F.when(F.col("_kind").isNull(), C.NO_DATABASE).when(
        ~found, F.coalesce("unavailable_reason", product))
    counts = ["active_connections", "idle_connections", "waiting_connections", "long_transactions", "lock_waits"]
    return joined_rows.select(
        "request_id", "project_id", "environment", "to_ts", F.when(found, "dbhealth-1").alias("evidence_id"), "snapshot_id",
        (found & F.col("_kind").isNotNull()).alias("available"), reason.alias("unavailable_reason"),
        *[F.when(found, F.col(c)).otherwise(0).cast("long").alias(c) for c in counts],
    ).where(~F.col("unavailable_reason").eqNullSafe(C.NO_DATABASE))
