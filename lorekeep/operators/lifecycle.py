"""Changes to the memory table, each from table to table; the writer decides where the new table goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import redact
from ..schema import SUPERSEDED, TRASH, dedup_safe, is_transcript, visible

#: Days that kinds of records live; others live on.
AUTO_LOG_DAYS, FILTERED_DAYS, TRASH_DAYS, JOB_DAYS = 30, 7, 30, 90
#: Ids of a batch that is purged at most.
BATCH_MAX = 100
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def remember(memories: DataFrame, incoming: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(id, project, document, status, existing_id) of incoming rows: succeeded, deduplicated or failed.

    Failed: no text. Deduplicated: an id that is stored, in a hidden bucket or purged, or given earlier among the incoming; or, for plain
    saved notes, the trimmed text of a visible plain note of the same project. Near-duplicates are stored.
    """
    rows = incoming.withColumn("document", redact(F.trim("document"))).withColumn("plain", dedup_safe())
    order = Window.partitionBy("id").orderBy("created_at", "document")
    rows = rows.withColumn("nth", F.row_number().over(order))
    stored = memories.select("id").union(tombstones.select("id")).distinct().withColumn("stored", F.lit(True))
    rows = rows.join(stored, "id", "left")
    key = F.sha2("document", 256)
    same = memories.where(visible() & dedup_safe()).groupBy("project", key.alias("text_key")).agg(F.min("id").alias("same_id")).withColumn("plain", F.lit(True))
    rows = rows.withColumn("text_key", key).join(same, ["project", "text_key", "plain"], "left")
    among = Window.partitionBy("project", "text_key", "plain").orderBy("created_at", "id")
    earlier = F.first("id").over(among)
    repeat = F.coalesce(F.col("stored"), F.lit(False)) | (F.col("nth") > 1)
    note = F.when(F.col("plain"), F.coalesce("same_id", F.when(earlier != F.col("id"), earlier)))
    status = F.when(F.coalesce(F.col("document"), F.lit("")) == "", "failed").when(repeat | note.isNotNull(), "deduplicated").otherwise("succeeded")
    return rows.withColumn("note", note).select("id", "project", "document", status.alias("status"), F.when(status == "deduplicated", F.when(repeat, F.col("id")).otherwise(F.col("note"))).alias("existing_id"))


def exact_duplicates(memories: DataFrame) -> DataFrame:
    """(id, canonical_id) of plain notes whose trimmed text an older one of their project has."""
    same = Window.partitionBy("project", F.sha2(F.trim("document"), 256)).orderBy("created_at", "id")
    return memories.where(visible() & dedup_safe()).withColumn("canonical_id", F.first("id").over(same)).where("id != canonical_id").select("id", "canonical_id")


def count_repeats(memories: DataFrame, remembered: DataFrame, at: Column) -> DataFrame:
    """The table with access_count raised, and the change dated, of notes that ``remembered`` (from ``remember``) met again under other ids."""
    again = remembered.where((F.col("status") == "deduplicated") & (F.col("existing_id") != F.col("id"))).groupBy(F.col("existing_id").alias("id")).agg(F.count("*").alias("__again"))
    rows = memories.join(again, "id", "left")
    met = F.col("__again").isNotNull()
    return rows.withColumns({"access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("__again", F.lit(0)), "updated_at": F.when(met, at).otherwise(F.col("updated_at"))}).drop("__again")


def new_deliveries(events: DataFrame, memories: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Delivered rows that are new: neither stored in any bucket nor purged, each id once."""
    known = memories.select("id").union(tombstones.select("id"))
    once = events.withColumn("__nth", F.row_number().over(Window.partitionBy("id").orderBy("created_at"))).where("__nth = 1").drop("__nth")
    return once.join(known, "id", "left_anti")


def supersede(memories: DataFrame, saved: DataFrame) -> DataFrame:
    """The table after ``saved`` (with supersedes): the rows they replace, active ones of the same project, are hidden; the new ones follow."""
    replaced = saved.where("supersedes is not null and supersedes != id").select(F.col("supersedes").alias("id"), F.col("project").alias("by")).distinct()
    rows = memories.join(replaced, "id", "left")
    gone = visible() & (F.col("by") == F.col("project"))
    hidden = rows.withColumn("scope_project", F.when(gone, F.col("project")).otherwise(F.col("scope_project"))).withColumn("project", F.when(gone, SUPERSEDED).otherwise(F.col("project"))).drop("by")
    return hidden.unionByName(saved.select(*[c for c in memories.columns if c in saved.columns]), allowMissingColumns=True)


def trash(memories: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """The table with the rows of ``ids`` in the trash; those that are there already stay as they are."""
    chosen = ids.select("id").distinct().withColumn("__chosen", F.lit(True))
    rows = memories.join(chosen, "id", "left")
    now = F.col("__chosen").isNotNull() & (F.col("project") != TRASH)
    return rows.withColumns(
        {
            "original_project": F.when(now, F.col("project")).otherwise(F.col("original_project")),
            "trashed_at": F.when(now, at).otherwise(F.col("trashed_at")),
            "scope_project": F.when(now & visible(), F.col("project")).otherwise(F.col("scope_project")),
            "project": F.when(now, TRASH).otherwise(F.col("project")),
        }
    ).drop("__chosen")


def restore(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The table with trashed rows of ``ids`` back where they came from; superseded ones are superseded again."""
    rows = memories.join(ids.select("id").distinct().withColumn("__chosen", F.lit(True)), "id", "left")
    back = F.col("__chosen").isNotNull() & (F.col("project") == TRASH)
    null = lambda c: F.when(~back, F.col(c))
    return rows.withColumns({"project": F.when(back, F.coalesce("original_project", F.lit("default"))).otherwise(F.col("project")), "original_project": null("original_project"), "trashed_at": null("trashed_at")}).drop("__chosen")


def purge(memories: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table without the trashed rows of ``ids``, ids of purged turns, which block a replay)."""
    gone = memories.where(F.col("project") == TRASH).join(ids.select("id").distinct(), "id", "left_semi")
    return memories.join(gone.select("id"), "id", "left_anti"), gone.where(is_transcript()).select("id")


def check_batch(ids: DataFrame, most: int = BATCH_MAX) -> None:
    """Raise unless there are 1 to ``most`` ids."""
    n = ids.select("id").distinct().limit(most + 1).count()
    if not 1 <= n <= most:
        raise ValueError(f"1 to {most} ids, not {n if n <= most else 'more'}")


def purge_batch(memories: DataFrame, ids: DataFrame, aliases: DataFrame, most: int = BATCH_MAX) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``purge`` of a bounded batch, and the aliases (alias_id, canonical_id) without those of the purged rows, which mustn't come back under an old name."""
    check_batch(ids, most)
    table, tombstones = purge(memories, ids)
    gone = memories.where(F.col("project") == TRASH).join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("canonical_id"))
    return table, tombstones, aliases.join(gone, "canonical_id", "left_anti").select(*aliases.columns)


def delete_permitted(memories: DataFrame, ids: DataFrame, writable: DataFrame) -> DataFrame:
    """``delete_batch`` for one who may write the projects of ``writable`` (project): (id, status).

    All permissions come before any change: if a row may not be written it is denied, and all others are refused with it.
    Rows in a hidden bucket belong to the project they came from.
    """
    of = F.when(visible(), F.col("project")).otherwise(F.col("scope_project"))
    asked = ids.select("id").distinct().join(memories.select("id", of.alias("scope"), F.lit(True).alias("known")), "id", "left")
    rows = asked.join(writable.select(F.col("project").alias("scope"), F.lit(True).alias("may")).distinct(), "scope", "left")
    rows = rows.withColumn("denied", F.col("known").isNotNull() & F.col("may").isNull())
    any_denied = F.broadcast(rows.agg(F.coalesce(F.max("denied"), F.lit(False)).alias("any_denied")))  # one row
    status = F.when(F.col("denied"), "denied").when(F.col("any_denied"), "refused").when(F.col("known").isNotNull(), "deleted").otherwise("not_found")
    return rows.join(any_denied, F.lit(True)).select("id", status.alias("status"))


def delete_batch(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, status) for every id asked for: deleted or not_found."""
    known = memories.select("id", F.lit(True).alias("known"))
    return ids.select("id").distinct().join(known, "id", "left").select("id", F.when(F.col("known").isNotNull(), "deleted").otherwise("not_found").alias("status"))


def prune_victims(memories: DataFrame, project: str, keep_latest: int | None = None, before: Column | None = None, chunk_type: str | None = None, importance: str | None = None, include_pinned: bool = False) -> DataFrame:
    """Rows of a project beyond its newest ``keep_latest`` and, if given, older than ``before``; pinned ones only if asked for, none without either bound.

    Only rows of the kind and importance asked for count, as kept ones too.
    """
    rows = memories.where(F.col("project") == project)
    if keep_latest is None and before is None:
        return rows.limit(0)
    for name, wanted in (("chunk_type", chunk_type), ("importance", importance)):
        rows = rows if wanted is None else rows.where(F.col(name) == wanted)
    rows = rows if include_pinned else rows.where(~F.col("pinned"))
    if keep_latest is not None:
        # the project is one, so the newest are found by a top list and the rest by what is older than those: no window over all its rows
        newest = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(keep_latest).select("id")
        rows = rows.join(newest, "id", "left_anti")
    return rows if before is None else rows.where(F.col("created_at") < before)


def prune_preview(victims: DataFrame, n: int = 20, head: int = 80) -> DataFrame:
    """A dry run: (id, project, created_at, preview, matched) of the newest ``n`` rows that would go; matched counts them all."""
    matched = F.broadcast(victims.agg(F.count("*").alias("matched")))  # one row
    shown = victims.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return shown.select("id", "project", "created_at", F.left("document", F.lit(head)).alias("preview")).join(matched, F.lit(True))


def days_since(at: Column, as_of: Column) -> Column:
    """Whole days that have passed."""
    return F.floor(F.timestamp_diff("SECOND", at, as_of) / 86400)


def expired(memories: DataFrame, as_of: Column, policy: DataFrame, auto_log_days: int | None = AUTO_LOG_DAYS) -> DataFrame:
    """(id, reason) of rows whose time is up: by their project's policy (days; pinned rows too), else by their kind."""
    rows = memories.where(visible()).join(policy.select("project", F.col("days").alias("policy_days")), "project", "left")
    forever = F.col("pinned") | F.col("importance").isin("knowledge", "decision", "preference") | is_transcript() | F.col("chunk_type").isin("manual", "consolidated")
    days = F.when(forever, F.lit(None).cast("int")).when(F.col("chunk_type") == "auto_log", F.lit(auto_log_days).cast("int")).when(F.col("chunk_type") == "filtered", FILTERED_DAYS)
    by_policy = F.col("policy_days").isNotNull() & (F.timestamp_add("DAY", F.col("policy_days").cast("int"), F.col("created_at")) <= as_of)
    by_kind = F.col("policy_days").isNull() & (days_since(F.col("created_at"), as_of) > days)
    return rows.select("id", F.when(by_policy, "policy").when(by_kind, "kind").alias("reason")).where("reason is not null")


def trash_due(memories: DataFrame, as_of: Column, days: int = TRASH_DAYS) -> DataFrame:
    """Trashed rows strictly older than so many days; rows without a date stay."""
    return memories.where((F.col("project") == TRASH) & (F.timestamp_add("DAY", F.lit(days), F.col("trashed_at")) < as_of))


def mark_reviewed(memories: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """The table with reviewed_at set on saved notes of ``ids`` that aren't sensitive."""
    rows = memories.join(ids.select("id").distinct().withColumn("__chosen", F.lit(True)), "id", "left")
    now = F.col("__chosen").isNotNull() & visible() & (F.col("chunk_type") == "manual") & ~F.col("sensitive")
    return rows.withColumn("reviewed_at", F.when(now, at).otherwise(F.col("reviewed_at"))).drop("__chosen")


def patch(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """The table with the fields that ``changes`` (id and any fields, null for no change) supply; confidence stays in 0 to 1.

    A changed text clears the review and the vector, which has to be computed anew.
    """
    fields = [c for c in changes.columns if c != "id"]
    rows = memories.join(changes.select("id", *(F.col(c).alias(f"__{c}") for c in fields)), "id", "left")
    new_text = F.col("__document").isNotNull() & (F.col("__document") != F.col("document")) if "document" in fields else F.lit(False)
    updated = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in fields}
    if "confidence" in fields:
        value = updated["confidence"]
        updated["confidence"] = F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))).cast("float")
    keep = F.when(~F.coalesce(new_text, F.lit(False)), F.lit(True))
    for c in ("reviewed_at", "embedding"):
        if c in memories.columns and c not in fields:
            updated[c] = F.when(keep, F.col(c))
    return rows.withColumns(updated).select(*memories.columns)


def invalid_fields(rows: DataFrame) -> DataFrame:
    """(id, problem) of rows that may not be saved; a verified_at that is still a text has to be a time of RFC 3339."""
    raw = "verified_at" in rows.columns and rows.schema["verified_at"].dataType == StringType()
    not_a_time = F.col("verified_at").isNotNull() & ~(F.col("verified_at").rlike(RFC3339) & F.try_to_timestamp(F.replace(F.upper("verified_at"), F.lit("T"), F.lit(" "))).isNotNull()) if raw else F.lit(False)
    problem = (
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1) | F.isnan("confidence"), "confidence")
        .when(F.trim("supersedes") == "", "supersedes")
        .when(not_a_time, "verified_at")
        .when(F.char_length("approach.applicability") > 2048, "approach.applicability")
        .when(F.char_length("approach.evidence") > 4096, "approach.evidence")
    )
    return rows.select("id", problem.alias("problem")).where("problem is not null")


def newest_per_actor(events: DataFrame, actor: str, keep: int = 1000) -> DataFrame:
    """Events without all but the newest ``keep`` of one actor: the others' aren't sorted."""
    order = [F.desc("created_at"), F.desc("id")]
    kept = events.where(F.col("actor") == actor).orderBy(*order).limit(keep)
    return events.where(~F.coalesce(F.col("actor") == actor, F.lit(False))).unionByName(kept)


def latest_jobs(updates: DataFrame, restarted: bool = False) -> DataFrame:
    """The last state of each job, by aggregation; after a restart, those under way have failed."""
    names = [c for c in updates.columns if c != "job_id"]
    last = F.max_by(F.struct(*names), F.struct("updated_at", "state")).alias("r")
    rows = updates.groupBy("job_id").agg(last).select("job_id", "r.*").select(*updates.columns)
    return rows.withColumn("state", F.when(F.col("state").isin("queued", "running"), "failed").otherwise(F.col("state"))) if restarted else rows


def kept_jobs(jobs: DataFrame, as_of: Column, days: int = JOB_DAYS) -> DataFrame:
    """Jobs that changed within so many days."""
    return jobs.where(F.col("updated_at") >= F.timestamp_add("DAY", F.lit(-days), as_of))


def compare_evidence(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(id, path, status): fingerprints stored with a record against today's (path, sha256; null if unreadable)."""
    now = current.select("path", F.col("sha256").alias("now"), F.lit(True).alias("there"))
    rows = stored.join(now, "path", "left")
    status = F.when(F.col("there").isNull(), "missing").when(F.col("now").isNull(), "unavailable").when(F.col("now") == F.col("sha256"), "unchanged").otherwise("changed")
    return rows.select("id", "path", status.alias("status"))


def evidence_status(compared: DataFrame, captured: DataFrame | None = None, workspace_id: str | None = None) -> DataFrame:
    """(id, status) of each record's files together: unchanged if all are, unavailable if one is, else changed.

    Files captured in another workspace (``captured``: id, workspace_id) aren't compared: different_workspace.
    """
    state = F.when(F.bool_and(F.col("status") == "unchanged"), "unchanged").when(F.bool_or(F.col("status") == "unavailable"), "unavailable").otherwise("changed")
    found = compared.groupBy("id").agg(state.alias("status"))
    if captured is None:
        return found
    elsewhere = captured.where(~F.col("workspace_id").eqNullSafe(F.lit(workspace_id))).select("id", F.lit("different_workspace").alias("elsewhere"))
    return found.join(elsewhere, "id", "full").select("id", F.coalesce("elsewhere", "status").alias("status"))
