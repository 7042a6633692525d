"""Fusion, admission and the final score of candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_latin_term, is_ascii, is_korean, keywords, topic_keywords
from ..schema import Config
from .corpus import turns


def candidate_limit(n: Column, scoped: Column) -> Column:
    """Candidates of each list: four times the results over all projects, twenty times in a scope, within 20 to 1000."""
    wanted = F.greatest(F.least(n, F.lit(50)), F.lit(1))
    return F.greatest(F.least(wanted * F.when(scoped, 20).otherwise(4), F.lit(1000)), F.lit(20))


def with_limits(queries: DataFrame) -> DataFrame:
    return queries.withColumn("candidates", candidate_limit(F.col("n"), F.coalesce(F.size("scope"), F.lit(0)) > 0).cast("int"))


def fuse(vector: DataFrame, text: DataFrame, config: Config | None = None, digits: int | None = 6) -> DataFrame:
    """(query_id, id, fused, distance, text_score): weighted reciprocal ranks, 1 at most."""
    config = config or Config()
    k, w = config.rrf_k, config.text_weight
    both = vector.select("query_id", "id", "distance", F.col("rank").alias("rank_v")).join(text.select("query_id", "id", F.col("score").alias("text_score"), F.col("rank").alias("rank_t")), ["query_id", "id"], "full")
    fused = (F.coalesce(k / (k + F.col("rank_v")), F.lit(0.0)) + w * F.coalesce(k / (k + F.col("rank_t")), F.lit(0.0))) / (1 + w)
    return both.select("query_id", "id", (fused if digits is None else F.round(fused, digits)).alias("fused"), "distance", "text_score")


def fuse_many(rankings: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, id, score) from any number of rankings (query_id, id, rank from 0), all of one weight."""
    return rankings.groupBy("query_id", "id").agg(F.sum(1.0 / (k + 1 + F.col("rank"))).alias("score"))


def neighbour_bonus(fused: DataFrame, memories: DataFrame, config: Config | None = None, digits: int | None = 9) -> DataFrame:
    """``fused`` with a share of the better score among a turn's neighbours added.

    Neighbours are next to each other in the whole session; they count if they are candidates themselves.
    """
    config = config or Config()
    numbered = turns(memories).select("id", "turn_no", F.xxhash64("project", "session_id", "source", F.coalesce("cwd", F.lit("\0"))).alias("session"))
    placed = fused.join(numbered, "id", "left")
    order = Window.partitionBy("query_id", "session").orderBy("turn_no")
    beside = lambda f, step: F.when(f("turn_no").over(order) == F.col("turn_no") + step, f("fused").over(order))
    best = F.greatest(F.coalesce(beside(F.lag, -1), F.lit(0.0)), F.coalesce(beside(F.lead, 1), F.lit(0.0)))
    boosted = F.col("fused") + F.when(F.col("session").isNotNull(), config.neighbour_share * best).otherwise(0.0)
    return placed.withColumn("fused", boosted if digits is None else F.round(boosted, digits)).drop("turn_no", "session")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, though a function within calls for it again and again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def keyword_ratio(document: Column, words: Column) -> Column:
    """The share of the keywords, repeats counted, that occur anywhere in the text."""
    hits = _once(F.lower(document), lambda low: F.size(F.filter(words, lambda w: F.contains(low, F.lower(w)))))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(0.0)


def topic_hits(document: Column, words: Column) -> Column:
    """Topic keywords (each once) that a text holds, those in ASCII as whole words."""
    plain = F.filter(words, lambda w: w.rlike("^[0-9a-z]+$"))
    others = F.filter(words, lambda w: ~w.rlike("^[0-9a-z]+$"))
    whole = F.size(F.array_intersect(plain, F.split(F.lower(document), "[^0-9a-z]+")))
    return whole + _once(F.lower(document), lambda low: F.size(F.filter(others, lambda w: F.when(is_ascii(w), has_latin_term(low, w)).otherwise(F.contains(low, w)))))


def on_topic(hits: Column, distance: Column, other_language: Column, topics: Column, config: Config | None = None) -> Column:
    """Whether keywords and distance together show the query's topic; never without a distance."""
    c = config or Config()
    near = ((hits >= 2) & (distance <= c.two_keywords)) | ((hits >= 1) & (distance <= c.one_keyword)) | (other_language & (topics >= 2) & (distance <= c.other_language))
    return F.coalesce(distance.isNotNull() & near, F.lit(False))


def importance_bonus(importance: Column) -> Column:
    return F.when(importance == "knowledge", 0.10).when(importance == "preference", 0.08).when(importance == "decision", 0.05).otherwise(0.0)


def type_bonus(chunk_type: Column) -> Column:
    return F.when(chunk_type == "manual", 0.10).when(chunk_type == "consolidated", 0.03).when(chunk_type == "auto_log", -0.05).otherwise(0.0)


def seconds_between(earlier: Column, later: Column) -> Column:
    """Whole seconds from one timestamp to another."""
    return F.timestamp_diff("SECOND", earlier, later)


def age_penalty(updated_at: Column, as_of: Column, config: Config | None = None) -> Column:
    """Days since the last change, at a rate, up to a cap; none for a change to come."""
    c = config or Config()
    days = F.greatest(seconds_between(updated_at, as_of), F.lit(0)) / 86400.0
    return F.least(days * c.age_rate, F.lit(c.age_cap))


def final_score(fused: Column, ratio: Column, importance: Column, chunk_type: Column, updated_at: Column, as_of: Column, config: Config | None = None) -> Column:
    """Relevance, capped without a keyword, and what importance, kind and age add or take."""
    c = config or Config()
    part = c.fusion_max * fused
    part = F.when(ratio == 0.0, F.least(part, F.lit(c.no_keyword_cap))).otherwise(part)
    return part + c.keyword_bonus * ratio + importance_bonus(importance) + type_bonus(chunk_type) - age_penalty(updated_at, as_of, c)


def with_words(queries: DataFrame) -> DataFrame:
    """Add the keywords, topic keywords and named identifiers of each query."""
    korean = is_korean("text")
    named = lambda w: korean & is_ascii(w) & w.rlike("[A-Za-z]")
    return queries.withColumn("words", keywords("text")).withColumn("topics", topic_keywords("text")).withColumn("korean", korean).withColumn("identifiers", F.filter("words", named))


def admitted(candidates: DataFrame, config: Config | None = None) -> DataFrame:
    """Candidates with a word of the query, and the first few near ones without.

    candidates: rows that passed all filters, with query_id, id, fused, distance, listed_distance, text_score, ratio, words. Only the
    latter are ranked against each other, in fused order; a query of one word admits none of them.
    """
    c = config or Config()
    lexical = F.col("text_score").isNotNull() & (F.col("ratio") > 0)
    near = F.coalesce(F.col("listed_distance") <= c.distance_cutoff, F.lit(False))
    order = Window.partitionBy("query_id", "lexical", "near").orderBy(F.desc("fused"), "id")
    marked = candidates.withColumn("lexical", lexical).withColumn("near", near).withColumn("place", F.row_number().over(order))
    budget = F.when(F.size("words") >= 2, c.vector_only).otherwise(0)
    return marked.where(F.col("lexical") | (F.col("near") & (F.col("place") <= budget))).drop("lexical", "near", "place")


def keep_named(candidates: DataFrame) -> DataFrame:
    """Where a candidate names an identifier of the query, only those that do."""
    names = F.exists("identifiers", lambda w: has_latin_term(F.col("document"), w))
    any_named = F.max("names").over(Window.partitionBy("query_id"))
    return candidates.withColumn("names", names).withColumn("any_named", any_named).where("names or not any_named").drop("names", "any_named")
