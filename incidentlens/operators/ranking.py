"""Top-n and numbering per group, without ever putting one whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentlens.session import materialize



def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int | Column, rank: str = "rank_no",
          most: int | None = None) -> DataFrame:
    """The first ``n`` rows of every group in ``order``, numbered from 1.

    Every task first cuts its part of a group to the largest ``n`` of all rows, so that at most
    that many rows per task and group are shuffled; each row's own ``n`` is applied to the final
    rank. ``most`` is that largest ``n`` where the caller knows it (``largest`` of a small table);
    without it the rows themselves are asked.
    """
    if isinstance(n, int):
        most = n
    elif most is None:
        most = largest(df, n)
    whole = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= F.lit(most))
    return ranked if isinstance(n, int) else ranked.where(F.col(rank) <= n)


def largest(df: DataFrame, n: Column) -> int:
    """The largest limit of any row; 0 for an empty table."""
    return df.agg(F.max(n).cast("int").alias("n")).first()["n"] or 0


def number_rows(df: DataFrame, keys: list[str], order: list[Column], out: str = "row_no") -> DataFrame:
    """Number the rows of every group from 1 in a total ``order``.

    A range shuffle on (keys, order) spreads a hot group over many tasks. The sorted rows are
    written once; a row's number is its place inside its task plus the rows of the same group in
    earlier tasks. The table of these offsets has one row per task and group only.
    """
    keys_cols = [F.col(k) for k in keys]
    placed = (
        df.repartitionByRange(*keys_cols, *order)
        .sortWithinPartitions(*keys_cols, *order)
        .withColumn("_task", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    held = materialize(placed)
    runs = held.groupBy(*keys, "_task").agg(F.min("_place").alias("_start"), F.count("*").alias("_rows"))
    earlier = (
        Window.partitionBy(*(keys_cols or [F.lit(0)])).orderBy("_task")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = runs.select(
        *keys, "_task", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_start") + 1).alias("_shift")
    )
    return held.join(offsets, [*keys, "_task"]).withColumn(
        out, F.col("_place") + F.col("_shift")
    ).drop("_task", "_place", "_shift")
