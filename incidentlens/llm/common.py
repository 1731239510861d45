"""What the operators of this package share: reading a table, row keys, written intermediate data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.session import materialize

__all__ = ["in_batches", "join_hot", "lower_ascii", "materialize", "read_table", "struct_of", "values_table"]

#: Bytes of a batch of rows in a Python worker; a longer single row is a batch by itself.
BATCH_BYTES = 8 << 20
#: A key with at least this share of all rows is hot: there are at most ``1 / HOT_SHARE`` of them.
HOT_SHARE = 1 / 1000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Only A-Z change; ``lower`` would also change other scripts."""
    return F.translate(text, UPPER, UPPER.lower())


def values_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small table of fixed rows, built from literals."""
    names = list(rows[0])
    return spark.range(1).select(F.inline(F.array(*[struct_of(row, names) for row in rows])))


def struct_of(row: dict, names: list[str]) -> Column:
    return F.struct(*[
        (F.array(*[F.lit(x) for x in row[n]]) if isinstance(row[n], list) else F.lit(row[n])).alias(n) for n in names
    ])


def in_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes; a worker gives the memory of its batches back when a task ends."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) != str(BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """Inner join with a written ``table`` of one row for each key and the number of ``rows`` that have it.

    Rows of hot keys, of which there are at most ``1 / HOT_SHARE``, take theirs by broadcast; a hot key is never dealt to one task.
    """
    hot = F.col(copies) >= max(1, total * HOT_SHARE)
    few = F.broadcast(table.where(hot))
    plain = rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti").join(table.where(~hot), keys)
    return rows.join(few, keys).unionByName(plain)
