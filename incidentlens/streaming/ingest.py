"""Continuous ingest of posted change events with Structured Streaming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from incidentlens.session import materialize
from incidentlens.sources.store import last_change_id, prepare_changes

#: Folder of the highest id of each batch; readers of the store skip names that begin so.
IDS = "_ids"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def last_id_before(spark: SparkSession, store: str, batch_id: int) -> int:
    """The highest id of the batches before this one, from the small table of ids; a store without it is asked itself, once."""
    ids = _stored(spark, f"{store}/{IDS}")
    if ids is not None:
        return ids.where(F.col("batch_id") < batch_id).agg(F.coalesce(F.max("last_id"), F.lit(0))).first()[0]
    stored = _stored(spark, store)
    return last_change_id(stored.where(F.col("batch_id") < batch_id)) if stored is not None else 0


def note_last_id(spark: SparkSession, store: str, batch_id: int, last_id: int) -> None:
    """One row for the batch, written after its events: a batch that is run again begins at the same id."""
    row = spark.range(1).select(F.lit(last_id).cast("long").alias("last_id"), F.lit(batch_id).alias("batch_id"))
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{store}/{IDS}")


def start_ingest(submitted: DataFrame, projects: DataFrame, store: str, progress: str,
                 continuous: bool = False) -> StreamingQuery:
    """Validate, redact and append every micro-batch of a stream of posted change events.

    A batch writes its own partition ``batch_id`` and replaces it when it is run again, and its
    ids continue after those of earlier batches, so a repeated batch leaves the same rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        last = last_id_before(batch.sparkSession, store, batch_id)
        rows = materialize(prepare_changes(batch, projects, last)).withColumn("batch_id", F.lit(batch_id))
        dated = rows.withColumn("occurred_on", F.to_date("occurred_at"))
        (dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id", "project_id", "environment", "occurred_on").parquet(store))
        note_last_id(batch.sparkSession, store, batch_id, max(last, last_change_id(rows)))

    writer = submitted.writeStream.foreachBatch(write).option("checkpointLocation", progress)
    return (writer if continuous else writer.trigger(availableNow=True)).start()
