"""Record layout, reserved names, defaults and scoring constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets addressable by id alone: never counted, listed or searched.
HIDDEN = ("_trash", "_superseded")
TRASH, SUPERSEDED = HIDDEN
#: Dropped from results over all projects, on request.
RESERVED = ("root", "default", "global")
#: In every workspace's scope.
PLAYBOOK = "playbook"
CARD_COLLECTIONS = ("task-cards", "task-cards-done")
DURABLE = ("manual", "consolidated")

CODE_EVIDENCE = "struct<workspace_id:string,captured_at:timestamp_ntz,git_head:string,files:array<struct<path:string,sha256:string>>>"
METADATA = (
    "chunk_type string, importance string, category string, memory_kind string, session_id string, cwd string, scope_project string, "
    "parent_session_id string, source string, adapter string, adapter_version string, confidence float, "
    f"approach struct<status:string,applicability:string,evidence:string>, code_evidence {CODE_EVIDENCE}, source_ids array<string>, "
    "supersedes string, verified_at timestamp_ntz, reviewed_at timestamp_ntz, role string, tool string, event_id string, sequence long, total long, "
    "truncated boolean, raw_chunk string, access_count long, keywords array<string>, sensitive boolean, pinned boolean, original_project string, trashed_at timestamp_ntz"
)
#: The record with its metadata as columns of their own, which prune better than a JSON text.
MEMORY = f"id string, project string, document string, embedding array<float>, created_at timestamp_ntz, updated_at timestamp_ntz, {METADATA}"
DEFAULTS = {
    "chunk_type": "auto_log",
    "importance": "log",
    "category": "general",
    "memory_kind": "record",
    "session_id": "",
    "truncated": False,
    "access_count": 0,
    "sensitive": False,
    "pinned": False,
}


@dataclass(frozen=True)
class Config:
    """Scoring constants; distances depend on the embedding model."""

    distance_cutoff: float = 0.7
    vector_only: int = 3
    age_rate: float = 0.008
    age_cap: float = 0.30
    keyword_bonus: float = 0.08
    rrf_k: float = 10.0
    text_weight: float = 0.5
    fusion_max: float = 0.10
    no_keyword_cap: float = 0.049
    neighbour_share: float = 0.15
    mmr_lambda: float = 0.5
    two_keywords: float = 0.18
    one_keyword: float = 0.13
    other_language: float = 0.21
    same_subject: float = 0.035
    same_subject_shared: float = 0.07
    shared_keywords: float = 0.45
    bm25_k1: float = 1.2
    bm25_b: float = 0.75


def with_defaults(df: DataFrame) -> DataFrame:
    """Rows that lack a field get its default; missing columns are added."""
    for part in MEMORY.split(", "):
        name, kind = part.split(" ", 1)
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()})


def visible(project: str | Column = "project") -> Column:
    """Not in a hidden bucket."""
    return ~(F.col(project) if isinstance(project, str) else project).isin(*HIDDEN)


def is_transcript() -> Column:
    """A captured turn: an automatic record of a transcript source with an event."""
    return (F.col("chunk_type") == "auto_log") & (F.coalesce("event_id", F.lit("")) != "") & F.coalesce(F.col("source").endswith(".transcript"), F.lit(False))


def dedup_safe() -> Column:
    """A plain saved note without provenance: an equal text may count as the same note."""
    bare = [F.col(c).isNull() for c in ("supersedes", "verified_at", "approach", "code_evidence", "confidence", "event_id")]
    plain = (F.col("chunk_type") == "manual") & (F.col("importance") == "knowledge") & (F.col("category") == "general") & (F.col("memory_kind") == "record")
    out = plain & (F.coalesce(F.size("source_ids"), F.lit(0)) <= 0)
    for c in bare:
        out &= c
    return out
