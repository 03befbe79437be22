"""Documents that arrive over time: facts in micro-batches, daily figures with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessellis.operators.extraction import extract_facts


def stream_facts(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Facts of the new documents of every micro-batch, one folder a batch: a batch run again overwrites its own folder.

    The discourse of a document stays inside it, so a document that comes whole needs no state between batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        extract_facts(batch.dropDuplicates(["document_id"])).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_figures(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Count and sum of each event type and window; events later than the watermark are left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total")
