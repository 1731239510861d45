"""Log rows from tables, and the choice of log source per project."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens import constants as C
from incidentlens.functions.logline import utc_to_wallclock, wallclock_to_utc
from incidentlens.functions.text import exception_attributes
from incidentlens.operators.joins import request_evidence
from incidentlens.operators.ranking import largest, number_rows, top_n
from incidentlens.schemas import LOG_EVENTS, conform
from incidentlens.session import broadcast_if_small, request_scope

_TABLE = re.compile(rf"{C.TABLE_NAME_PART}(?:\.{C.TABLE_NAME_PART})?")


def checked_table_name(name: str) -> str:
    """``view`` or ``schema.view`` of plain identifiers; anything else is refused."""
    if not name or not _TABLE.fullmatch(name):
        raise ValueError(f"not a plain table name: {name!r}")
    return name


def open_log_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(checked_table_name(name))


def open_jdbc_log_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """The canonical columns of a database view; Spark pushes range and level filters into it."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", checked_table_name(name))
    return reader.options(**options).load().select("occurred_at", "level", "trace_id", "message", "stack_trace")


def kept_level(logs: DataFrame, exact: bool = False) -> DataFrame:
    """WARN and ERROR rows: exact spelling in text files, any case in tables."""
    level = F.col("level") if exact else F.upper("level")
    return logs.where(level.isin(C.KEPT_LEVELS))


def most_recent(rows: DataFrame, n, time_col: str = "occurred_at", seq_col: str = "arrival_seq", most: int | None = None) -> DataFrame:
    """The newest ``n`` rows per request; of equal times the earlier arrival wins."""
    return top_n(rows, ["request_id"], [F.desc(time_col), F.col(seq_col)], n, most=most)


def first_arrived(rows: DataFrame, n, seq_col: str = "arrival_seq", most: int | None = None) -> DataFrame:
    """The first ``n`` rows per request in source order."""
    return top_n(rows, ["request_id"], [F.col(seq_col)], n, most=most)


def capped_logs(requests: DataFrame, logs: DataFrame, source_type: str = "mock",
                n=None) -> DataFrame:
    """Log rows per request as a source with a row limit delivers them, for exact parity.

    The limit (``max_results`` of each request unless ``n`` is given) applies before clustering,
    so counts saturate. Arrival follows the source: list order for ``mock``, rising time for text
    files, falling time for tables; text files and tables keep the newest rows.
    """
    limit = F.col("max_results") if n is None else n
    most = largest(requests, limit) if n is None else n
    if source_type == "mock":
        return first_arrived(request_evidence(requests, logs), limit, most=most)
    rows = request_evidence(requests, kept_level(logs, exact=source_type == "local-file"))
    place = F.col("rank_no").cast("long")
    return most_recent(rows, limit, most=most).withColumn("arrival_seq", -place if source_type == "local-file" else place)


def scan_log_table(requests: DataFrame, table: DataFrame, zone: str = "UTC",
                   n: int | str | None = "max_results") -> DataFrame:
    """Newest WARN/ERROR rows of a log table per request, in UTC, with the exception class.

    Stored times are wall-clock times of ``zone``. The request range is moved into that zone, so
    the comparison is on the stored column and reaches the scan. ``n`` is a number or the
    request's column that holds it; ``None`` keeps every row.
    """
    local = requests.withColumns({c: utc_to_wallclock(F.col(c), zone) for c in ("from_ts", "to_ts")})
    scope = request_scope(local)
    rows = request_evidence(local, kept_level(table), scope=scope)
    utc = rows.withColumn("occurred_at", wallclock_to_utc(F.col("occurred_at"), zone)).drop("from_ts", "to_ts")
    if isinstance(n, str):
        utc = most_recent(utc, F.col(n), most=largest(requests, F.col(n)))
    elif n is not None:
        utc = most_recent(utc, n)
    ranges = requests.select("request_id", "from_ts", "to_ts")
    with_range = utc.join(F.broadcast(ranges) if scope.small else ranges, "request_id")
    return with_range.withColumn("attributes", exception_attributes(F.col("stack_trace")))


def named(value: str | Column) -> Column:
    """A project's or environment's name: the same for all rows, or an expression over them."""
    return F.lit(value) if isinstance(value, str) else value


def log_view_events(table: DataFrame, project_id: str | Column, environment: str | Column, zone: str = "UTC") -> DataFrame:
    """The five canonical columns of a log view as log rows (``LOG_EVENTS``).

    A view of one project has its names given; one that many share has columns for them. Stored times are wall-clock times of ``zone``. Only WARN and ERROR rows are kept. Rows arrive
    by falling time; of equal times by their other columns.
    """
    rows = kept_level(table).select(
        named(project_id).alias("project_id"), named(environment).alias("environment"),
        wallclock_to_utc(F.col("occurred_at"), zone).alias("occurred_at"), "level", "trace_id", "message", "stack_trace",
        exception_attributes(F.col("stack_trace")).alias("attributes"),
    ).where(F.col("occurred_at").isNotNull())
    order = [F.desc("occurred_at"), *[F.col(c).asc_nulls_first() for c in ("level", "trace_id", "message", "stack_trace")]]
    return conform(number_rows(rows, [], order, "arrival_seq"), LOG_EVENTS)


def route_logs(projects: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Log rows of each project from the one source its ``logs_type`` names.

    A null type means ``mock``; an unknown type or project yields nothing. ``sources`` holds one
    normalized log table per type.
    """
    chosen = broadcast_if_small(projects.select("project_id", F.coalesce("logs_type", F.lit("mock")).alias("source_type")))
    routed = None
    for kind, logs in sources.items():
        mine = chosen.where(F.col("source_type") == kind)
        rows = conform(logs, LOG_EVENTS).join(mine, "project_id")
        routed = rows if routed is None else routed.unionByName(rows)
    return routed
