"""Queries in the query syntax, evaluated as boolean trees over positional postings.

Leaves meet the documents first: words and phrases by their postings (a phrase stands where
its words' positions, moved back by their offsets, have places in common), exact fields by
their value. Then each level of the trees, the deepest first, becomes the hits of its
groups: one aggregation by group and document, whatever the shape of the trees. A group
holds where all its demanded parts do and none of the ruled-out ones; without demanded
parts, one of the others has to. Its score is the sum of its parts' scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grammar import DEFAULT, MUST, NOT, SHOULD, rows
from ..functions.text import TOKEN_BYTES, all_tokens, fits, tokens
from ..schema import Config, visible
from ..sources import folders
from .vector import small_batches

#: Postings with places.
POSTINGS = "id string, project string, length int, term string, at array<int>"
_TREE = "array<struct<node:int,parent:int,depth:int,role:string,boost:double,field:string,leaf:string>>"


def trees(queries: DataFrame) -> DataFrame:
    """(query_id, node, parent, depth, role, boost, field, leaf): the nodes of the queries that are of the syntax."""
    tree = F.udf(lambda text: rows(text), _TREE, useArrow=True)
    return queries.select("query_id", F.explode(tree("text")).alias("n")).select("query_id", "n.*")


def strict(nodes: DataFrame) -> DataFrame:
    """(query_id, depth) of the queries that say more than some words, any of which may stand in a document."""
    wordy = (F.col("role") == SHOULD) & (F.col("depth") <= 1) & (F.col("boost") == 1)
    leaf = F.col("leaf").isNull() | ((F.col("field") == DEFAULT) & (F.size(tokens("leaf")) <= 1))
    found = nodes.groupBy("query_id").agg(F.min(wordy & leaf).alias("plain"), F.max("depth").alias("depth"))
    return found.where(~F.col("plain")).select("query_id", "depth")


def occurrences(memories: DataFrame) -> DataFrame:
    """(id, project, length, term, pos): each token that the index holds, in its place; length counts them."""
    docs = memories.select("id", "project", all_tokens("document").alias("tokens"))
    # below the explode, where it is taken once a document
    sized = docs.select("id", "project", F.size(F.filter("tokens", fits)).alias("length"), "tokens")
    return sized.select("id", "project", "length", F.posexplode("tokens").alias("pos", "term")).where(fits("term"))


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and token that the index holds, with the token's places; length counts the document's."""
    for batch in batches:
        column = batch.column("tokens")
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        doc, pos = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hit = np.flatnonzero(pc.less_equal(pc.binary_length(flat), TOKEN_BYTES).to_numpy(zero_copy_only=False))
        if not len(hit):
            continue
        coded = flat.take(pa.array(hit)).dictionary_encode()
        # by term and document, so that equal terms lie together in the file
        key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sizes) + doc[hit]
        order = np.argsort(key, kind="stable")  # places stay in order
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        own = pa.array(key[first] % len(sizes))
        at = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(pos[hit[order]], pa.int32()))
        lengths = pa.array(np.bincount(doc[hit], minlength=len(sizes)), pa.int32())
        term = coded.dictionary.take(pa.array(key[first] // len(sizes)))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(own), batch.column("project").take(own), lengths.take(own), term, at], ["id", "project", "length", "term", "at"])


def positions(memories: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, project, length, term, at) of the visible documents, for the terms listed; at: the places of a term, from 0.

    A document's tokens meet in its own row: nothing is shuffled for it.
    """
    small_batches(memories.sparkSession)
    docs = memories.where(visible()).select("id", "project", all_tokens("document").alias("tokens"))
    found = docs.mapInArrow(places, POSTINGS)
    return found.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").select("id", "project", "length", "term", "at")


def idf(documents: Column, df: Column) -> Column:
    return F.log(1 + (documents - df + 0.5) / (df + 0.5))


def text_hits(leaves: DataFrame, memories: DataFrame, stats: DataFrame, config: Config) -> DataFrame:
    """(query_id, node, id, project, score) of words and phrases."""
    words = leaves.where(F.col("field") == DEFAULT).select("query_id", "node", F.posexplode(all_tokens("leaf")).alias("offset", "term")).where(fits("term"))
    sizes = words.groupBy("query_id", "node").agg(F.count("*").alias("n"))
    # read for the frequencies and for the hits
    found = folders.kept(positions(memories, words))
    frequency = found.groupBy("term").agg(F.count("*").alias("df"))
    weighted = found.join(frequency, "term").join(F.broadcast(stats), F.lit(True)).withColumn("idf", idf(F.col("documents"), F.col("df")))
    met = words.join(sizes, ["query_id", "node"]).join(weighted, "term")
    moved = F.transform("at", lambda p: p - F.col("offset"))
    held = met.groupBy("query_id", "node", "n", "id", "project", "length", "average").agg(F.count("*").alias("met"), F.collect_list(moved).alias("held"), F.sum("idf").alias("idf")).where("met = n")
    tf = F.size(F.aggregate(F.slice("held", 2, F.size("held")), F.element_at("held", 1), F.array_intersect))
    k1, b = config.bm25_k1, config.bm25_b
    score = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
    return held.withColumn("tf", tf).where("tf > 0").select("query_id", "node", "id", "project", score.alias("score"))


def value_hits(leaves: DataFrame, memories: DataFrame, stats: DataFrame, name: str) -> DataFrame:
    """(query_id, node, id, project, score) of a field with one exact value; each counts as a word that stands once."""
    docs = memories.where(visible()).select("id", "project")
    asked = leaves.where(F.col("field") == name).select("query_id", "node", F.col("leaf").alias("value"))
    held = docs.withColumn("value", F.col(name)).join(asked.select("value").distinct(), "value", "left_semi")
    frequency = held.groupBy("value").agg(F.count("*").alias("df"))
    rows = asked.join(frequency, "value").join(held, "value").join(F.broadcast(stats), F.lit(True))
    return rows.select("query_id", "node", "id", "project", idf(F.col("documents"), F.col("df")).alias("score"))


def evaluate(queries: DataFrame, nodes: DataFrame, deepest: int, memories: DataFrame, stats: DataFrame, config: Config | None = None) -> DataFrame:
    """(query_id, id, project, score) of the documents that queries' trees hold for, within the queries' scopes.

    ``deepest`` is the greatest depth of a node; ``stats`` has one row, documents and their average length.
    """
    config = config or Config()
    leaves = nodes.where(F.col("leaf").isNotNull())
    wide = F.coalesce(F.size("scope"), F.lit(0)) <= 0
    hits = text_hits(leaves, memories, stats, config)
    for name in ("project", "id"):
        hits = hits.unionByName(value_hits(leaves, memories, stats, name))
    hits = hits.join(queries.select("query_id", "scope"), "query_id").where(wide | F.array_contains("scope", F.col("project"))).drop("scope")
    place = nodes.select("query_id", "node", "parent", "depth", "role")
    demands = nodes.where(F.col("role") == MUST).groupBy("query_id", F.col("parent").alias("node")).agg(F.count("*").alias("demands"))
    groups = nodes.where(F.col("leaf").isNull()).select("query_id", "node", "boost").join(demands, ["query_id", "node"], "left").withColumn("demands", F.coalesce("demands", F.lit(0)))
    # each level reads the leaves' hits: they are computed once
    leaf_hits = folders.kept(hits.join(place.select("query_id", "node", "depth"), ["query_id", "node"]))
    level = leaf_hits.where(F.col("depth") == deepest).drop("depth")
    for depth in range(deepest, 0, -1):
        parts = level.join(place.where(F.col("depth") == depth), ["query_id", "node"])
        count = lambda role: F.count_if(F.col("role") == role)
        met = parts.groupBy("query_id", F.col("parent").alias("node"), "id", "project").agg(
            count(MUST).alias("must"), count(NOT).alias("ruled_out"), count(SHOULD).alias("others"), F.sum(F.when(F.col("role") != NOT, F.col("score")).otherwise(0.0)).alias("sum")
        )
        holds = (F.col("must") == F.col("demands")) & (F.col("ruled_out") == 0) & (F.col("must") + F.col("others") > 0)
        found = met.join(groups, ["query_id", "node"]).where(holds).select("query_id", "node", "id", "project", (F.col("sum") * F.col("boost")).alias("score"))
        level = found.unionByName(leaf_hits.where(F.col("depth") == depth - 1).drop("depth"))
    return level.select("query_id", "id", "project", "score")
