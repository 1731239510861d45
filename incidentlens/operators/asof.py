"""The newest row up to a time, without ever putting one whole key into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentlens.session import materialize


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], name: str, at: str, seen: str, pick: str) -> DataFrame:
    """``name`` and ``keys`` of every left row that has one, with ``seen`` and ``pick`` of its newest right row up to the time ``at``.

    Of right rows at the same time the one of the largest ``pick`` counts; one without a time never does. Both sides stand in one
    line, dealt by range of (keys, time) and sorted, so a row meets its task's part of its key only; what earlier tasks hold of the
    key comes from a table of one row for each task and key. No row count is above left plus right.
    """
    asks = left.select(
        *keys, F.col(name).alias("_name"), F.col(at).alias("_at"), F.lit(1).alias("_asks"), F.lit(None).alias("_row"))
    tells = right.where(F.col(seen).isNotNull()).select(
        *keys, F.lit(None).alias("_name"), F.col(seen).alias("_at"), F.lit(0).alias("_asks"), F.struct(seen, pick).alias("_row"))
    order = [*keys, "_at", "_asks", "_row"]
    line = materialize(
        asks.unionByName(tells).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_task", F.spark_partition_id()))
    so_far = Window.partitionBy("_task", *keys).orderBy("_at", "_asks", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = line.withColumn("_here", F.last("_row", ignorenulls=True).over(so_far)).where("_asks = 1")
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    carried = line.groupBy("_task", *keys).agg(F.max("_row").alias("_end")).select(
        "_task", *keys, F.max("_end").over(earlier).alias("_carried"))
    found = here.join(carried, ["_task", *keys]).withColumn("_latest", F.coalesce("_here", "_carried"))
    return found.where(F.col("_latest").isNotNull()).select(F.col("_name").alias(name), *keys, "_latest.*")
