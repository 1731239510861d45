"""Links between evidence of two kinds: by trace first, then by request, by module, and by time alone."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentlens.functions.rules import evidence_strength
from incidentlens.session import epoch_micros, materialize

#: How two pieces of evidence are linked, strongest first.
TRACE_ID, REQUEST_SCOPED, MODULE_SCOPED, TEMPORAL_ONLY = "TRACE_ID", "REQUEST_SCOPED", "MODULE_SCOPED", "TEMPORAL_ONLY"
#: Seconds between a slow request and a slow statement, and between a log and a database anomaly.
STATEMENT_WINDOW_SECONDS, DATABASE_WINDOW_SECONDS = 30, 60
SCOPE = ["project_id", "environment"]


@dataclass(frozen=True)
class Tier:
    """One kind of link: the columns that must agree besides the scope, and the largest distance in time (None: any)."""

    label: str
    keys: tuple[str, ...] = ()
    seconds: float | None = None


def tiers(seconds: float = STATEMENT_WINDOW_SECONDS) -> list[Tier]:
    return [
        Tier(TRACE_ID, ("trace_id",)),
        Tier(REQUEST_SCOPED, ("request_uri", "sql_source"), seconds),
        Tier(MODULE_SCOPED, ("module", "exception_class"), seconds),
        Tier(TEMPORAL_ONLY, (), seconds),
    ]


def nearest(left: DataFrame, right: DataFrame, keys: list[str], name: str, at: str, seen: str, pick: str) -> DataFrame:
    """``name`` of every left row that has a right row of its ``keys``, with ``pick`` and ``seen`` of the one nearest in time, and
    the distance ``gap_us``. Of two equally near ones the earlier counts, of those at one time the smallest ``pick``.

    Rows with a null key or time have no partner. Both sides stand in one line, dealt by range of (keys, time), so a key that holds
    a third of all rows is spread over many tasks; what the tasks before and behind hold of a key comes from a table of one row
    for each task and key. No row count is above left plus right.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    tells = right.where(known & F.col(seen).isNotNull()).groupBy(*keys, F.col(seen).alias("_at")).agg(F.min(pick).alias("_pick"))
    line = materialize(
        left.where(known & F.col(at).isNotNull()).select(
            *keys, F.col(at).alias("_at"), F.lit(1).alias("_asks"), F.col(name).alias("_name"), F.lit(None).alias("_row"))
        .unionByName(tells.select(
            *keys, "_at", F.lit(0).alias("_asks"), F.lit(None).alias("_name"), F.struct("_at", "_pick").alias("_row")))
        .repartitionByRange(*keys, "_at", "_asks", "_name")
        .sortWithinPartitions(*keys, "_at", "_asks", "_name").withColumn("_task", F.spark_partition_id()))
    own, until = Window.partitionBy("_task", *keys), (Window.unboundedPreceding, Window.currentRow)
    order = ["_at", "_asks", "_name"]
    here = line.withColumns({
        "_before": F.last("_row", ignorenulls=True).over(own.orderBy(*order).rowsBetween(*until)),
        # read backwards, so that the frame still grows by one row at a time
        "_after": F.last("_row", ignorenulls=True).over(own.orderBy(*[F.desc(c) for c in order]).rowsBetween(*until)),
    }).where("_asks = 1")
    of_key, rest = Window.partitionBy(*keys), (Window.unboundedPreceding, -1)
    carried = line.groupBy("_task", *keys).agg(F.min("_row").alias("_first"), F.max("_row").alias("_last")).select(
        "_task", *keys, F.max("_last").over(of_key.orderBy("_task").rowsBetween(*rest)).alias("_earlier"),
        F.min("_first").over(of_key.orderBy(F.desc("_task")).rowsBetween(*rest)).alias("_later"))
    distance = {side: F.abs(epoch_micros(F.col("_at")) - epoch_micros(F.col(f"{side}._at"))) for side in ("_before", "_after")}
    found = here.join(carried, ["_task", *keys]).withColumns({
        "_before": F.coalesce("_before", "_earlier"), "_after": F.coalesce("_after", "_later"),
    }).withColumns({"_gap_before": distance["_before"], "_gap_after": distance["_after"]})
    earlier = F.col("_gap_after").isNull() | (F.col("_gap_before") <= F.col("_gap_after"))
    best = found.withColumn("_best", F.when(earlier, F.col("_before")).otherwise(F.col("_after")))
    return best.where(F.col("_best").isNotNull()).select(
        F.col("_name").alias(name), F.col("_best._pick").alias(pick), F.col("_best._at").alias(seen),
        F.least("_gap_before", "_gap_after").alias("gap_us"))


def link_evidence(left: DataFrame, right: DataFrame, kinds: list[Tier] | None = None) -> DataFrame:
    """Every left row (unique ``evidence_id``) with its partner on the right side, the kind of the link, its distance and strength.

    Both sides: evidence_id, project_id, environment, occurred_at and the key columns of the tiers. The first tier in which a row
    has a partner counts, and there the partner nearest in time. A link by time alone is never ``definite``. Rows without any
    partner stay, with strength WEAK.
    """
    kinds = tiers() if kinds is None else kinds
    partners = right.withColumnsRenamed({"evidence_id": "linked_id", "occurred_at": "linked_at"})
    found = [
        rows if tier.seconds is None else rows.where(F.col("gap_us") <= int(tier.seconds * 1_000_000))
        for tier in kinds
        for rows in [nearest(left, partners, [*SCOPE, *tier.keys], "evidence_id", "occurred_at", "linked_at", "linked_id")]
    ]
    ranked = [rows.withColumn("_tier", F.lit(n)) for n, rows in enumerate(found)]
    best = reduce(DataFrame.unionByName, ranked).groupBy("evidence_id").agg(
        F.min(F.struct("_tier", "gap_us", "linked_id")).alias("_best"))
    labels: Column = F.array(*[F.lit(tier.label) for tier in kinds])
    linked = left.select("evidence_id", *SCOPE).join(best, "evidence_id", "left").withColumn(
        "correlation_type", F.get(labels, F.col("_best._tier")))
    sources = F.when(F.col("_best").isNull(), 1).otherwise(2)
    return linked.select(
        "evidence_id", *SCOPE, "_best.linked_id", "correlation_type", "_best.gap_us",
        F.coalesce(F.col("correlation_type") != TEMPORAL_ONLY, F.lit(False)).alias("definite"),
        evidence_strength(sources, F.coalesce(F.col("correlation_type") == TRACE_ID, F.lit(False)), F.lit(False)).alias("strength"))
