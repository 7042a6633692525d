"""BM25 over the memory table for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..schema import Config, visible
from ..sources import folders
from . import boolean
from .vector import Best, passes, small_batches

#: Pairs of a posting and a query that are added up at once.
CELLS = 1 << 19


def postings(memories: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, project, length, term, tf) of the visible documents, for the terms listed alone.

    Tokens are counted within each document's row; only those of a listed term leave it.
    """
    docs = memories.where(visible()).select("id", "project", tokens("document").alias("tokens")).withColumn("length", F.size("tokens"))
    return docs.select("id", "project", "length", F.explode("tokens").alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("id", "project", "length", "term").agg(F.count("*").alias("tf"))


def corpus_statistics(memories: DataFrame) -> DataFrame:
    """One row: documents and their average length, over all visible ones."""
    return memories.where(visible()).select(F.size(tokens("document")).alias("length")).agg(F.count("*").alias("documents"), F.avg("length").alias("average"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), each term once."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))


def bm25(queries: DataFrame, memories: DataFrame, config: Config | None = None, digits: int | None = 6) -> DataFrame:
    """(query_id, id, score): any word of the query, statistics over the whole store, scope applied before ranking."""
    config = config or Config()
    asked = query_terms(queries)
    found = postings(memories, asked)
    frequency = found.groupBy("term").agg(F.count("*").alias("df"))
    n, df, tf, k1, b = F.col("documents"), F.col("df"), F.col("tf"), config.bm25_k1, config.bm25_b
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("average")))
    weighted = found.join(frequency, "term").join(F.broadcast(corpus_statistics(memories)), F.lit(True)).select("term", "id", "project", weight.alias("weight"))
    wide = F.coalesce(F.size("scope"), F.lit(0)) <= 0
    scoped = asked.join(queries.select("query_id", "scope"), "query_id")
    hits = scoped.join(weighted, "term").where(wide | F.array_contains("scope", F.col("project"))).groupBy("query_id", "id").agg(F.sum("weight").alias("score"))
    return hits if digits is None else hits.withColumn("score", F.round("score", digits))


def text_top(queries: DataFrame, memories: DataFrame, k: str | int = "candidates", config: Config | None = None, digits: int | None = 6, syntax: bool = False) -> DataFrame:
    """(query_id, id, score, rank from 0), the best of each query; with ``syntax``, texts of the query syntax count as such.

    The table is read twice, once for the words' frequencies and once for the scores: each task compares its documents
    with all queries as one sparse product, within their scopes, keeps the best of each query it has, and only
    those meet in the window that ranks them. Queries go in passes of bounded size; those that say more than words
    are few, and are joined to positional postings.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    most = k if isinstance(k, int) else None
    limit = (F.lit(most) if most else F.col(k)).cast("int").alias("k")
    config, plain, out = config or Config(), queries, None
    small_batches(queries.sparkSession)
    if syntax:
        nodes = boolean.trees(queries.select("query_id", "text"))
        odd = boolean.strict(nodes)
        deepest = odd.agg(F.max("depth")).first()[0]
        if deepest is not None:
            plain = queries.join(odd, "query_id", "left_anti")
            hits = boolean.evaluate(queries, nodes.join(odd.select("query_id"), "query_id", "left_semi"), deepest, memories, folders.kept(corpus_statistics(memories)), config)
            score = F.col("score") if digits is None else F.round("score", digits)
            out = hits.withColumn("score", score).join(queries.select("query_id", limit), "query_id").select("query_id", "id", "score", "k")
    rows = plain.select("query_id", F.array_distinct(tokens("text")).alias("terms"), "scope", limit)
    for part in passes(rows.where(F.size("terms") > 0), F.char_length(F.array_join("terms", "")) + 60 * F.size("terms")):
        found = _scores(part, memories, config, digits)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id string, score double, rank int")
    return out.withColumn("rank", F.row_number().over(order) - 1).where("rank < k").drop("k")


def _scores(rows: list, memories: DataFrame, config: Config, digits: int | None) -> DataFrame:
    """(query_id, id, score, k): what each task's documents have that may be among the best of a query. What a task holds grows with the queries' words, not with their product."""
    spark = memories.sparkSession
    terms = sorted({t for r in rows for t in r["terms"]})
    docs = memories.where(visible()).select("id", "project", tokens("document").alias("tokens"))
    listed = spark.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, n, length = pa.array(listed.value, pa.string()), np.zeros(len(listed.value), np.int64), 0, 0
        for batch in batches:
            doc, term, lengths = listed_terms(batch.column("tokens"), known)
            df += np.bincount(np.unique(doc * len(df) + term) % len(df), minlength=len(df))
            n += batch.num_rows
            length += int(lengths.sum())
        at = np.flatnonzero(df)
        # the numbers of documents and of their words under -1 and -2
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2], pa.int64()), pa.array([*df[at].tolist(), n, length], pa.int64())], ["at", "n"])

    df, sums = np.zeros(len(terms)), {}
    for r in docs.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        if r["at"] < 0:
            sums[r["at"]] = r["n"]
        else:
            df[r["at"]] = r["n"]
    n, average = sums.get(-1, 0), sums.get(-2, 0) / max(1, sums.get(-1, 0))
    weights = np.log(1 + (n - df + 0.5) / (df + 0.5)) * (config.bm25_k1 + 1)
    place = {t: i for i, t in enumerate(terms)}
    asked = [np.array([place[t] for t in r["terms"]]) for r in rows]
    held = spark.sparkContext.broadcast((terms, weights, average, asked, [set(r["scope"] or ()) for r in rows], [r["query_id"] for r in rows], [r["k"] for r in rows]))
    kind = "long" if type(rows[0]["query_id"]) is int else "string"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, average, asked, scopes, names, ks = held.value
        known, best = pa.array(terms, pa.string()), Best(ks, largest=True)
        askers, first = by_term(asked, len(terms))
        wide = np.array([not scope for scope in scopes])
        for batch in batches:
            doc, term, lengths = listed_terms(batch.column("tokens"), known)
            cell, tf = np.unique(doc * len(terms) + term, return_counts=True)
            doc, term = cell // len(terms), cell % len(terms)
            weight = weights[term] * tf / (tf + config.bm25_k1 * (1 - config.bm25_b + config.bm25_b * lengths[doc] / average))
            ids = np.array(batch.column("id").to_pylist(), object)
            projects = [p or "" for p in batch.column("project").to_pylist()]
            # documents on end whose postings meet ``CELLS`` queries at most
            met = np.diff(first)[term]
            sums = np.concatenate([[0], np.cumsum(met)])
            start = 0
            while start < len(doc):
                end = max(int(np.searchsorted(sums, sums[start] + CELLS, "right")) - 1, start + 1)
                if end < len(doc):  # whole documents, one at least
                    back = int(np.searchsorted(doc, doc[end]))
                    end = back if back > start else int(np.searchsorted(doc, doc[start], "right"))
                own = np.arange(start, end)
                q = askers[np.repeat(first[term[own]] - (sums[own] - sums[start]), met[own]) + np.arange(sums[end] - sums[start])]
                at = np.repeat(doc[own], met[own])
                pair, place = np.unique(q * len(ids) + at, return_inverse=True)
                scores = np.bincount(place, np.repeat(weight[own], met[own]), len(pair))
                q, at = pair // len(ids), pair % len(ids)
                inside = wide[q]
                inside[~inside] = [projects[d] in scopes[x] for x, d in zip(q[~inside].tolist(), at[~inside].tolist(), strict=True)]
                q, at, scores = q[inside], at[inside], scores[inside]
                if digits is not None:
                    scores = np.round(scores, digits)
                cuts = np.flatnonzero(np.diff(q, prepend=-1))
                for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(q)], strict=True) if len(cuts) else ():
                    best.add(int(q[a]), scores[a:z], ids[at[a:z]])
                start = end
        yield from best.batches(names, ks, "score", pa.int64() if kind == "long" else pa.string())

    return docs.mapInArrow(score, f"query_id {kind}, id string, score double, k int")


def by_term(asked: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The queries of each of ``n`` terms, on end, and where each term's begin; asked: the terms of each query."""
    of_term = np.concatenate(asked)
    order = np.argsort(of_term, kind="stable")
    return np.repeat(np.arange(len(asked)), [len(own) for own in asked])[order], np.searchsorted(of_term[order], np.arange(n + 1))


def listed_terms(column: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each listed token of some documents its document and its place in the list; the documents' lengths."""
    flat = column.flatten()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(at >= 0)
    return np.repeat(np.arange(len(lengths)), lengths)[hit], at[hit].astype(np.int64), lengths
