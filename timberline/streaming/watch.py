"""Files to table, once or for as long as the stream runs."""

from __future__ import annotations

import os
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.ingest import ingest
from timberline.sources.tail import TailSource
from timberline.streaming.table import LogTable

#: Fixed value: how often files are looked at.
INTERVAL = "2 seconds"
#: Bytes that one batch of a running stream takes.
BATCH_BYTES = 1 << 30


def watch(spark: SparkSession, paths: str, table: LogTable, checkpoint: str, now_ms: int | None = None, once: bool = False, interval: str = INTERVAL, batch_bytes: int = BATCH_BYTES, quiet_ms: int = 2000):
    """Start the stream. Reading is at least once and rows are merged by identity,
    so the effect is exactly once. ``once`` reads what is there and ends. A running
    stream takes ``batch_bytes`` at a time and holds back the event that may still
    grow, until another begins or its file rests for ``quiet_ms``."""
    spark.dataSource.register(TailSource)
    source = spark.readStream.format("tail").option("paths", paths)
    if not once:
        folder = urlsplit(checkpoint).path  # a mounted folder, as the table's
        os.makedirs(folder, exist_ok=True)
        source = source.option("hold", "event").option("quietms", quiet_ms).option("maxbytes", batch_bytes).option("progress", f"{folder}/tail-progress.json")
    lines = source.load()

    def put(batch: DataFrame, _: int) -> None:
        now = F.lit(now_ms).cast("long") if now_ms is not None else F.unix_millis(F.current_timestamp())
        table.merge(ingest(batch, now))

    writer = lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def error_rate(logs: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Errors per fingerprint and time window, for streams and tables alike."""
    from timberline.plans.aggregate import keyed_errors

    timed = keyed_errors(logs).withColumn("at", F.timestamp_millis("timestamp_ms"))
    if logs.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "fingerprint").agg(F.count(F.lit(1)).alias("count"))
