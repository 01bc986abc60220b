"""Metrics and ingestion status from streams of files.

The state lives in Spark's state store or in the result table; none of it is in
the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import metrics
from docquarry.session import shared_dir
from docquarry.streaming import stateful
from docquarry.streaming.merged import MergedTable

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """Event files as a stream, with times Spark can set a watermark on."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_rates(events: DataFrame, window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Events per second of each type in consecutive windows."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    counted = grouped.agg(F.count("*").alias("n"))
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    return counted.select(
        F.col("window.start").alias("window_start"), "event_type", "n", (F.col("n") / seconds).alias("rate")
    )


def window_table(spark: SparkSession, path: str) -> MergedTable:
    """Windows as ``windowed_rates`` updates them; a count only grows, so the largest one holds.

    Fed in ``update`` mode: the stream forgets a window once it is behind the
    watermark, the table keeps it.
    """
    schema = spark.createDataFrame([], "window_start timestamp, event_type string, n bigint, rate double").schema
    return MergedTable(spark, path, ["window_start", "event_type"], {"n": F.max, "rate": F.max}, schema)


def counters(events: DataFrame) -> DataFrame:
    """Lifetime counters per type."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def status(log: DataFrame) -> DataFrame:
    """Current ingestion state per crate; see ``metrics.merge_status``."""
    return metrics.merge_status(log)


def run_available(stream: DataFrame, out: str | None = None, mode: str = "complete", period: str | None = None) -> str:
    """Process what is there, or keep going every ``period``; returns the result folder.

    Whole results (``complete``) replace the folder, finished ones (``append``)
    are added to it.
    """
    base = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    out = out or f"{base}/result"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress")
    trigger = {"processingTime": period} if period else {"availableNow": True}
    if mode == "append":
        query = writer.format("parquet").option("path", out).trigger(**trigger).start()
    else:

        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        query = writer.foreachBatch(replace).trigger(**trigger).start()
    if period is None:
        query.awaitTermination()
    return out


def keep_history(events: DataFrame, per_type: int, out: str | None = None) -> str:
    """Keep the last events of every type, and write them to a folder when all that is there has been read.

    They are kept in the state store, so a batch costs what it brings and no table
    is rewritten between batches; see ``stateful.track_history``.  A later call
    with the same ``out`` goes on where this one stopped.
    """
    spark = events.sparkSession
    base = out or stateful.stream_folder(spark, "history")
    query = stateful.run_history(events, per_type, f"{base}/progress")
    last = query.lastProgress
    path = f"{base}/kept-{last['batchId'] if last else uuid.uuid4().hex}"
    stateful.history(spark, f"{base}/progress", per_type).write.mode("overwrite").parquet(path)
    return path
