"""Audit rows: what a request's evidence was, as counts and a digest that does not depend on order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digests(*columns: str) -> tuple[Column, Column]:
    """Two numbers of 60 bits from a row's columns; a null differs from every text."""
    shown = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    digest = F.md5(F.concat_ws("\x1f", *shown).cast("binary"))
    return tuple(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)") for start in (1, 16))


def evidence_audit(rows: DataFrame, *columns: str, key: str = "request_id") -> DataFrame:
    """One row for each ``key``: number of rows, characters of the columns, and the digest of all of them.

    Rows are hashed one by one and the hashes summed, so tasks combine before the shuffle, equal rows count as often as they
    stand, and any change of a row changes the digest.
    """
    first, second = row_digests(*columns)
    size = sum((F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns), F.lit(0))
    return rows.groupBy(key).agg(
        F.count("*").alias("rows"), F.sum(size.cast("long")).alias("characters"), F.sum(first).alias("_a"), F.sum(second).alias("_b"),
    ).select(key, "rows", "characters", F.concat_ws("-", F.col("_a").cast("string"), F.col("_b").cast("string")).alias("payload_digest"))


def append_audit(audit: DataFrame, path: str, day: str) -> None:
    """Append the audit rows of one run; earlier ones are never rewritten."""
    audit.withColumn("audited_on", F.lit(day)).write.mode("append").partitionBy("audited_on").parquet(path)
