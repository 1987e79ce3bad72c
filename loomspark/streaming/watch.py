"""Watching for changes as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspark.functions.paths import extension


def windowed_changes(changes: DataFrame, window: str, slide: str | None = None, watermark: str | None = "10 minutes") -> DataFrame:
    """``window_start, kind, changes, first_at, last_at`` of ``ts, kind`` rows, in tumbling or sliding windows.

    On a stream, rows later than the watermark are left out and the state of closed windows is dropped; a batch counts
    all. Rows without a time are in no window.
    """
    df = changes.withWatermark("ts", watermark) if changes.isStreaming and watermark else changes
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = df.groupBy(span.alias("w"), "kind").agg(F.count(F.lit(1)).alias("changes"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return out.select(F.col("w.start").alias("window_start"), "kind", "changes", "first_at", "last_at")


def debounced(changes: DataFrame, gap: str, watermark: str = "10 minutes") -> DataFrame:
    """``session_start, session_end, kind, changes``: changes of a kind with no pause longer than ``gap`` are one."""
    df = changes.withWatermark("ts", watermark) if changes.isStreaming else changes
    out = df.groupBy(F.session_window("ts", gap).alias("w"), "kind").agg(F.count(F.lit(1)).alias("changes"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "kind", "changes")


def change_stream(spark: SparkSession, folder: str, schema: str = "path string, ts timestamp, kind string", extensions: tuple[str, ...] = (), ignore: tuple[str, ...] = (), files_per_batch: int = 100) -> DataFrame:
    """Change records from JSON files that arrive in a folder, by extension and without ignored places."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    if extensions:
        df = df.filter(extension(F.col("path")).isin(*extensions))
    for part in ignore:
        df = df.filter(~F.contains("path", F.lit(part)))
    return df


def watch(changes: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, postpone: bool = False) -> StreamingQuery:
    """Runs a function on every batch of changes; with ``postpone`` not on the first. Without ``every`` what is there is
    worked off and the query ends. A restart goes on after the last batch that was done."""

    def one(df: DataFrame, number: int) -> None:
        if not (postpone and number == 0):
            run(df, number)

    writer = changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
