"""Session helpers: where lineage is cut, and when a side is small enough to broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow columns up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


#: Session settings the jobs are meant to run with.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Groups are cut to their limit in every task before the shuffle, whatever the limit is.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
    "spark.sql.session.timeZone": "UTC",
    # Of a repeated key in a JSON text the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Plans are built from many column calls; call sites need not be recorded for each of them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate data: the cluster's ``spark.checkpoint.dir``.

    Only a local session, as in tests, may leave the setting out.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="incidentlens-")
    context.setCheckpointDir(configured)
    return context._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage; readers after this never repeat the work above it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_all(*builders: Callable[[], DataFrame]) -> list[DataFrame]:
    """Materialize independent tables at the same time, so that their jobs share the cluster."""
    session = SparkSession.getActiveSession()

    def build(builder: Callable[[], DataFrame]) -> DataFrame:
        return materialize(builder())

    with ThreadPoolExecutor(len(builders)) as pool:
        return list(pool.map(inheritable_thread_target(session)(build), builders))


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """True when ``df`` has at most ``rows`` rows; counting stops just above the bound."""
    rows = BROADCAST_ROWS if rows is None else rows
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only after a row count; otherwise the join stays a shuffle join."""
    return F.broadcast(df) if is_small(df, rows) else df


def interval(seconds: float) -> Column:
    return F.expr(f"INTERVAL '{seconds}' SECOND")


def instant(text: str) -> Column:
    """A UTC wall-clock literal that reaches the scan as a pushed filter."""
    return F.to_timestamp_ntz(F.lit(text))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a UTC wall-clock column, whatever the session time zone."""
    since = ts.cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


@dataclass
class RequestScope:
    """Request ranges split by day, with what a join needs to know before it is planned."""

    days: DataFrame
    rows: int
    earliest: str | None
    latest: str | None

    @property
    def small(self) -> bool:
        return self.rows <= BROADCAST_ROWS


def request_scope(requests: DataFrame) -> RequestScope:
    """One small aggregate over the requests: how many request days, and their outer range."""
    ranged = requests.where(F.col("from_ts") <= F.col("to_ts"))
    bounds = ranged.agg(
        F.sum(F.datediff(F.to_date("to_ts"), F.to_date("from_ts")) + 1).alias("rows"),
        F.min("from_ts").cast("timestamp_ntz").cast("string").alias("earliest"),
        F.max("to_ts").cast("timestamp_ntz").cast("string").alias("latest"),
    ).first()
    days = ranged.select(
        "request_id", "project_id", "environment", "from_ts", "to_ts", "max_results",
        F.explode(F.sequence(F.to_date("from_ts"), F.to_date("to_ts"))).alias("_day"),
    )
    return RequestScope(days, bounds["rows"] or 0, bounds["earliest"], bounds["latest"])
