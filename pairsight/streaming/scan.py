"""Streams: incremental scans, latest scan wins, running totals, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.catalogue import COUNTED, FLAGGED


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; the same plan over a table or a stream."""
    # watermarks need a time with a zone; tables keep the zone-less time they have
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").cast(events.schema["ts"].dataType).alias("start"), "event_type", "n", "total")


def running_totals(results: DataFrame) -> DataFrame:
    """Flagged and counted tests of each pair, for a stream in update mode."""
    return results.groupBy("pair_id").agg(F.count_if(F.col("verdict").isin(*FLAGGED)).alias("flagged"), F.count_if(F.col("verdict").isin(*COUNTED)).alias("counted"))


def latest(results: DataFrame) -> DataFrame:
    """Of each pair and test the row of the latest scan; results of earlier scans are stale."""
    cols = [c for c in results.columns if c not in ("pair_id", "engine_id")]
    best = results.groupBy("pair_id", "engine_id").agg(F.max_by(F.struct(*cols), "scan_id").alias("r"))
    return best.select("pair_id", "engine_id", "r.*")


def scan_stream(arrivals: DataFrame, scan, sink: str, checkpoint: str) -> StreamingQuery:
    """Scan arriving rows batch by batch and append results; a batch that is replayed is written once.

    ``scan`` maps a batch to (pair_id, engine_id, value, verdict); rows get the batch as scan_id.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        scan(batch).withColumn("scan_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/scan_id_{batch_id}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
