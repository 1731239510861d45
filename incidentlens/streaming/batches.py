"""Continuous ingest of posted batches: repeats within the watermark are dropped, refused ones kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from incidentlens import constants as C
from incidentlens.operators.batches import batch_events, batch_reason


def start_batch_ingest(posted: DataFrame, accepted: str, rejected: str, progress: str, max_events: int,
                       keep: str = C.BATCH_REPEAT_WINDOW, continuous: bool = False) -> tuple[StreamingQuery, StreamingQuery]:
    """Two queries over the same stream: events of accepted batches, each request id once, and the refused batches.

    A request id is remembered for ``keep`` of event time after it was received, longer than a batch may be stale, so a batch that is
    posted again or read again changes nothing. Each micro-batch replaces its own partition.
    """
    judged = posted.withColumn("reject_reason", batch_reason(max_events))
    fine = judged.where(F.col("reject_reason").isNull()).withColumn("_received", F.col("received_at").cast("timestamp"))
    once = fine.withWatermark("_received", keep).dropDuplicatesWithinWatermark(["token_project", "request_id"]).drop("_received")

    def into(path: str):
        def write(batch: DataFrame, batch_id: int) -> None:
            (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(path))
        return write

    def start(rows: DataFrame, path: str, name: str) -> StreamingQuery:
        writer = rows.writeStream.foreachBatch(into(path)).option("checkpointLocation", f"{progress}/{name}")
        return (writer if continuous else writer.trigger(availableNow=True)).start()

    return start(batch_events(once), accepted, "accepted"), start(judged.where(F.col("reject_reason").isNotNull()), rejected, "rejected")
