"""Scans of the memory table: projects, scopes, aliases, grants, saved lists, turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import redact
from ..schema import DURABLE, PLAYBOOK, RESERVED, is_transcript, visible

#: One captured session: a null folder is a folder like any other.
SESSION = ("project", "session_id", "source", "cwd")


def newest(memories: DataFrame, n: int | None = None) -> DataFrame:
    """Newest first, at most ``n``."""
    out = memories.orderBy(F.desc("created_at"), F.desc("id"))
    return out if n is None else out.limit(n)


def in_projects(memories: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows of the projects listed; no project, no row."""
    return memories.join(projects.select("project"), "project", "left_semi")


def lookup(memories: DataFrame, ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows by id, old ids through the alias table; asked_id is the id that was asked for."""
    known = aliases.select(F.col("alias_id").alias("asked_id"), "canonical_id")
    resolved = ids.select(F.col("id").alias("asked_id")).join(known, "asked_id", "left")
    return resolved.select("asked_id", F.coalesce("canonical_id", "asked_id").alias("id")).join(memories, "id")


def exclude_reserved(project: str | Column = "project", across_all: Column | bool = True) -> Column:
    """Hidden buckets always go, reserved ones where the search is over all projects and asks for it."""
    column = F.col(project) if isinstance(project, str) else project
    wide = F.lit(across_all) if isinstance(across_all, bool) else across_all
    return ~visible(column) | (wide & column.isin(*RESERVED))


def durable() -> Column:
    return F.col("chunk_type").isin(*DURABLE)


def rules(memories: DataFrame, n: int | None = None) -> DataFrame:
    """Saved preferences and rules, newest first."""
    return newest(memories.where(visible() & (F.col("chunk_type") == "manual") & ((F.col("importance") == "preference") | (F.col("memory_kind") == "rule"))), n)


def saved(memories: DataFrame, oldest_first: bool = False, n: int = 50) -> DataFrame:
    """Saved notes that aren't sensitive: latest change first, or those longest without review."""
    rows = memories.where(visible() & (F.col("chunk_type") == "manual") & ~F.col("sensitive"))
    if oldest_first:
        rows = rows.orderBy(F.greatest("created_at", F.coalesce("reviewed_at", "created_at")), "id")
    else:
        rows = rows.orderBy(F.desc("updated_at"), F.desc("id"))
    return rows.limit(max(1, min(n, 50)))


def shown(memories: DataFrame) -> DataFrame:
    """What a result shows of a record: masked text, its first 600 code points, its whole length."""
    masked = redact("document")
    return memories.withColumn("masked", masked).select("id", "project", F.left("masked", F.lit(600)).alias("document"), F.char_length("masked").cast("long").alias("doc_len"), "chunk_type", "importance", "category", "memory_kind", "updated_at")


def workspace_scope(asked: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(workspace_id, project) for each workspace asked for: itself, its old name if no other claims it, the playbook."""
    owners = workspaces.where("legacy_project is not null").groupBy("legacy_project").agg(F.count("*").alias("owners"))
    known = asked.select("workspace_id").join(workspaces.select("workspace_id", "legacy_project"), "workspace_id", "left").join(owners, "legacy_project", "left")
    names = F.array(F.col("workspace_id"), F.when(F.col("owners") == 1, F.col("legacy_project")), F.lit(PLAYBOOK))
    return known.select("workspace_id", F.explode(F.array_distinct(F.array_compact(names))).alias("project"))


def readable(memories: DataFrame, principals: DataFrame) -> DataFrame:
    """(principal, id) of the rows each principal may read: all for an administrator, else by grants; hidden rows by the project they came from."""
    of = F.when(visible(), F.col("project")).otherwise(F.col("scope_project"))
    rows = memories.select("id", of.alias("scope"))
    grants = principals.where("not admin").select("principal", F.explode("read_projects").alias("scope")).distinct()
    granted = rows.join(grants, "scope").select("principal", "id")
    admins = principals.where("admin").agg(F.collect_set("principal").alias("admins"))  # a policy has 128 principals at most
    everything = rows.join(F.broadcast(admins), F.lit(True)).select(F.explode("admins").alias("principal"), "id")
    return granted.unionByName(everything)


def granted_scope(asked: Column, grants: Column) -> Column:
    """The projects asked for that are granted; everything granted where all are asked for."""
    return F.when(F.array_contains(asked, "all"), grants).otherwise(F.array_intersect(asked, grants))


def turns(memories: DataFrame) -> DataFrame:
    """Captured turns with their number in the session, oldest first."""
    order = Window.partitionBy(*SESSION).orderBy("created_at", "id")
    return memories.where(is_transcript() & (F.col("session_id") != "") & visible()).withColumn("turn_no", F.row_number().over(order))


def adjacent(memories: DataFrame, reach: int = 5) -> DataFrame:
    """(id, offset, neighbour) for turns at most ``reach`` places apart in a session: one pass over each session, no join."""
    order = Window.partitionBy(*SESSION).orderBy("created_at", "id")
    numbered = turns(memories)
    near = [F.struct(F.lit(k).alias("offset"), (F.lag("id", -k).over(order) if k < 0 else F.lead("id", k).over(order)).alias("neighbour")) for k in range(-reach, reach + 1) if k]
    return numbered.withColumn("near", F.array(*near)).select("id", F.explode("near").alias("n")).select("id", "n.offset", "n.neighbour").where("neighbour is not null")
