"""Upkeep of the tables once an interval, driven by a stream of times."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lifecycle import expired, kept_jobs, purge, trash, trash_due
from ..sources import folders

#: Seconds between two passes.
EVERY = 86_400


@dataclass(frozen=True)
class Upkept:
    """The tables after a pass, and the ids that it moved or removed."""

    memories: DataFrame
    jobs: DataFrame
    tombstones: DataFrame
    trashed: DataFrame
    purged: DataFrame


def upkeep(memories: DataFrame, jobs: DataFrame, policy: DataFrame, as_of: Column) -> Upkept:
    """One pass at a time: rows whose time is up go to the trash, what has been there long enough goes, old jobs go.

    What this pass trashes is dated now, so the same pass doesn't remove it. The same tables and time give the same result,
    and a pass over its own result changes nothing.
    """
    due = trash_due(memories, as_of).select("id")
    left, tombstones = purge(memories, due)
    over = expired(left, as_of, policy).select("id")
    return Upkept(trash(left, over, as_of), kept_jobs(jobs, as_of), tombstones, over, due)


def maintain(ticks: DataFrame, checkpoint: str, marks: str, run: Callable[[Column, int], None], every: int = EVERY) -> StreamingQuery:
    """Start the stream: ``run`` gets the time that an interval began and its number, once for the newest interval that ``ticks`` (at) has reached.

    ``marks`` is a folder of the intervals that are done. A batch that is replayed finds its mark; one that failed before its
    mark runs again, so ``run`` has to be safe to repeat for the same time, as ``upkeep`` into whole tables is.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        newest = df.agg(F.max(F.floor(F.unix_timestamp("at") / every)).alias("slot")).first()["slot"]
        if newest is None or any(int(n) >= newest for n in folders.names(spark, marks) if n.isdigit()):
            return
        run(F.timestamp_seconds(F.lit(newest * every)), newest)
        fs, at = folders.filesystem(spark, f"{marks}/{newest}")
        fs.mkdirs(at)

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
