"""Hybrid search for a table of queries.

A queries row has query_id, text, embedding, scope (project names; empty for all), n, as_of, and may have category.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_korean
from ..schema import Config, visible
from .bm25 import text_top
from .corpus import durable, exclude_reserved
from .rank import admitted, final_score, fuse, keep_named, keyword_ratio, neighbour_bonus, on_topic, topic_hits, with_limits, with_words
from .select import diversify, mmr, recent_first
from .vector import cosine, nearest


@dataclass(frozen=True)
class Options:
    durable_only: bool = False
    on_topic_only: bool = False
    exclude_reserved: bool = False
    recent_first: bool = False
    mmr: bool = True
    #: Texts of the query syntax (phrases, fields, groups, operators) count as such; others are words.
    syntax: bool = True


def candidates(queries: DataFrame, memories: DataFrame, options: Options | None = None, config: Config | None = None) -> DataFrame:
    """Fused candidates of each query: query_id, id, fused, distance, text_score."""
    o, c = options or Options(), config or Config()
    asked = with_limits(queries).where(F.trim("text") != "")
    seen = memories.where(visible())
    both = fuse(nearest(asked, seen), text_top(asked, seen, config=c, syntax=o.syntax), c)
    return both if o.durable_only else neighbour_bonus(both, seen, c)


def scored(queries: DataFrame, memories: DataFrame, options: Options | None = None, config: Config | None = None, digits: int = 9) -> DataFrame:
    """Admitted candidates with score, on_topic and what the last step needs."""
    o, c = options or Options(), config or Config()
    found = candidates(queries, memories, o, c).withColumnRenamed("distance", "listed_distance")
    asked = with_words(with_limits(queries)).withColumnsRenamed({"embedding": "query_embedding"})
    category = F.lower(F.trim("wanted")) if "category" in queries.columns else F.lit("")
    if "category" in queries.columns:
        asked = asked.withColumnRenamed("category", "wanted")
    keep = ["query_id", "query_embedding", "scope", "n", "as_of", "candidates", "words", "topics", "korean", "identifiers", *(["wanted"] if "category" in queries.columns else [])]
    rows = found.join(memories.select("id", "project", "document", "embedding", "chunk_type", "importance", "category", "sensitive", "updated_at"), "id").join(asked.select(*keep), "query_id")
    scoped = F.coalesce(F.size("scope"), F.lit(0)) > 0
    rows = rows.where(~F.col("sensitive") & ~exclude_reserved("project", o.exclude_reserved))
    rows = rows.where(~scoped | F.array_contains("scope", F.col("project")))
    rows = rows.where((F.coalesce(category, F.lit("")) == "") | (F.col("category") == category))
    if o.durable_only:
        rows = rows.where(durable())
    rows = rows.withColumn("ratio", keyword_ratio(F.col("document"), F.col("words")))


    both = F.col("embedding").isNotNull() & F.col("query_embedding").isNotNull()
    rows = rows.withColumn("distance", F.when(both, F.abs(F.round(1 - cosine("embedding", "query_embedding"), 6))))
    rows = rows.withColumn("on_topic", on_topic(topic_hits(F.col("document"), F.col("topics")), F.col("distance"), F.col("korean") != is_korean("document"), F.size("topics"), c))
    if o.on_topic_only:
        rows = rows.where("on_topic")
    rows = admitted(rows, c)
    score = final_score(F.col("fused"), F.col("ratio"), F.col("importance"), F.col("chunk_type"), F.col("updated_at"), F.col("as_of"), c)
    return keep_named(rows.withColumn("score", F.round(score, digits)))


def search(queries: DataFrame, memories: DataFrame, options: Options | None = None, config: Config | None = None) -> DataFrame:
    """(query_id, rank, id, project, score, on_topic), the results of each query."""
    o, c = options or Options(), config or Config()
    rows = scored(queries, memories, o, c)
    if o.recent_first:
        out = recent_first(rows)
    elif o.mmr and 0 < c.mmr_lambda < 1:
        # the choice takes the small columns; the few chosen meet their documents afterwards
        chosen = mmr(rows.select("query_id", "id", "project", "score", "on_topic", "updated_at", "embedding", "n"), c.mmr_lambda)
        out = chosen.join(memories.select("id", "document"), "id")
    else:
        out = diversify(rows, [F.desc("score"), "id"])
    return out.select("query_id", "rank", "id", "project", "score", "on_topic", "updated_at", "document")
