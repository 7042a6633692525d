"""Counts over the store, its jobs, its audit trail and its captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PLAYBOOK, visible

#: Above these a clean-up is recommended.
ROOT_CHUNKS, DISK_BYTES = 50_000, 2 << 30


def collections(memories: DataFrame, meta: DataFrame, n: int = 1000) -> DataFrame:
    """Visible collections, the largest first."""
    rows = memories.where(visible()).groupBy("project").agg(
        F.count("*").alias("chunk_count"),
        F.count_if(F.col("chunk_type") == "manual").alias("manual_count"),
        F.count_if(F.col("chunk_type") == "auto_log").alias("autolog_count"),
        F.sum(F.char_length("document")).alias("text_chars"),
    )
    known = meta.select(F.col("name").alias("project"), "kind")
    kind = F.coalesce("kind", F.when(F.col("project") == PLAYBOOK, PLAYBOOK).otherwise("project"))
    return rows.join(known, "project", "left").select(F.col("project").alias("name"), "chunk_count", "manual_count", "autolog_count", kind.alias("kind"), "text_chars").orderBy(F.desc("chunk_count"), "name").limit(n)


def age_buckets(memories: DataFrame, as_of: Column, project: str = "root") -> DataFrame:
    """One row: how many of a project are older than 30, 90 and 180 days, in one pass."""
    older = lambda d: F.count_if(F.col("created_at") < F.timestamp_add("DAY", F.lit(-d), as_of)).alias(f"over_{d}d")
    return memories.where(F.col("project") == project).agg(*map(older, (30, 90, 180)))


def store_totals(memories: DataFrame) -> DataFrame:
    return memories.agg(F.count_if(visible()).alias("visible"), F.count("*").alias("stored"))


def by_project(memories: DataFrame) -> DataFrame:
    return memories.groupBy("project").agg(F.count("*").alias("chunks"))


def job_states(jobs: DataFrame) -> DataFrame:
    state = lambda s: F.count_if(F.col("state") == s).alias(s)
    return jobs.agg(*map(state, ("queued", "running", "failed")))


def audit_newest(events: DataFrame, n: int = 200) -> DataFrame:
    """The newest events of known actors."""
    return events.where("actor != 'unauthenticated'").orderBy(F.desc("id")).limit(min(n, 200))


def denied(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(F.col("outcome") == "denied").alias("denied"))


def latency(samples: DataFrame, column: str = "ms") -> DataFrame:
    return samples.agg(F.count(column).alias("searches"), F.coalesce(F.avg(column), F.lit(0.0)).alias("average"), F.coalesce(F.max(column), F.lit(0.0)).alias("slowest"))


def home_project(hits: DataFrame, least: int = 3) -> DataFrame:
    """(query_id, project): the project that most hits of a query are in, with at least three and not the playbook."""
    counted = hits.where(F.col("project") != PLAYBOOK).groupBy("query_id", "project").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "project")
    return counted.withColumn("place", F.row_number().over(order)).where("place = 1").select("query_id", "project")


def capture_report(turns: DataFrame) -> DataFrame:
    """Sums by file, and over all (path null)."""
    return turns.rollup("path").agg(*(F.sum(c).alias(c) for c in ("turns", "eligible", "new", "skipped")))


def recommendations(memories: DataFrame, disk_bytes: int) -> DataFrame:
    """(name) of the clean-ups that the store's size calls for."""
    found = memories.agg((F.count_if(F.col("project") == "root") > ROOT_CHUNKS).alias("root")).select(F.array_compact(F.array(F.when(F.col("root"), "prune_root"), F.when(F.lit(disk_bytes > DISK_BYTES), "free_disk"))).alias("names"))
    return found.select(F.explode("names").alias("name"))
