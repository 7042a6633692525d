"""Streams of transcript lines into the memory table, each turn once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lifecycle import new_deliveries
from ..sources.transcripts import own_headers, parse, to_memories, turns
from .state import carry_headers

LINES = "path string, offset long, value string"


def merge_batch(lines: DataFrame, memories: DataFrame, tombstones: DataFrame, as_of: Column) -> DataFrame:
    """New memory rows of a batch of lines, which may carry their files' headers: replays, hidden and purged turns are left out."""
    said = turns(lines) if "known" in lines.columns else parse(lines)
    return new_deliveries(to_memories(said, as_of), memories, tombstones)


def ingest(lines: DataFrame, checkpoint: str, memories: Callable[[], DataFrame], tombstones: Callable[[], DataFrame], append: Callable[[DataFrame, int], None], as_of: Callable[[], Column] = F.current_timestamp, once: bool = False, every: str = "5 seconds", headers: bool = False) -> StreamingQuery:
    """Start the stream: ``append`` gets the new rows and the number of each batch, and may get a batch again after a failure.

    ``memories`` and ``tombstones`` read the tables as they are when a batch comes. With ``headers``, files' headers are
    kept from batch to batch, for sources that deliver a file in parts.
    """
    if headers:
        lines = carry_headers(own_headers(lines))

    def batch(df: DataFrame, number: int) -> None:
        append(merge_batch(df, memories(), tombstones(), as_of()), number)

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def file_lines(spark: SparkSession, folder: str, most: int = 100) -> DataFrame:
    """New files of lines as a stream; for files that grow, use the tail source.

    A file is read whole, so that its header reaches its lines in the same batch.
    """
    whole = spark.readStream.schema("value string").option("wholetext", "true").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most).format("text").load(folder)
    rows = whole.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("offset", "value"))
    return rows.select("path", F.col("offset").cast("long"), "value")


def activity(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of events (ts, user_id) with a watermark; works on tables and streams."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def is_alive(heartbeat: Column, as_of: Column, interval: int = 5) -> Column:
    """A watcher counts as active for three intervals, five minutes at least."""
    return F.timestamp_diff("SECOND", heartbeat, as_of) <= max(3 * interval, 300)
