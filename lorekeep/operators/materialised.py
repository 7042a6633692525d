"""Materialised search tables: postings and vector lists that are refreshed instead of rebuilt.

A store is a folder. Each write is a generation: files of its own for the postings and
vectors of the rows that changed, and the ids whose earlier entries are dead from then on.
A generation counts once its commit is there, so readers never see half of one, and what a
failed write left behind is replaced by the next. Nothing is rewritten until ``build``
starts the store anew, which a change of ``VERSION`` demands.

Changes come as a queue (id, operation, generation): an operation that follows another on
the same id takes its place and a greater generation. ``refresh`` reads the rows of the
queued ids alone, and returns what it has done; ``complete`` takes off the queue only what
still has the generation that was done, so a change queued meanwhile is done next time.

Vectors lie in lists around centroids that are fitted on a bounded sample. A search looks
into the lists whose centroids are nearest; ``build`` takes the number of lists from where
the true neighbours of sampled vectors lie, so that the wanted share of them is found.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import all_tokens, tokens
from ..schema import Config, visible
from ..sources import folders
from .boolean import POSTINGS, idf, places
from .vector import Best, nearest, passes, small_batches

VERSION = 1
UPSERT, DELETE = "upsert", "delete"
#: Folders that the postings of a generation are dealt to, by a hash of the term.
BUCKETS = 32
#: Files that a task may have open: with as many as there are folders, Spark needn't sort rows by their folder.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Vectors that centroids are fitted on at most, lists at most, rounds of the fit; stored vectors that the number of probed lists is measured with, and their neighbours that count.
SAMPLE, MOST_LISTS, ROUNDS, ASKED, NEIGHBOURS = 20_000, 4096, 8, 200, 10
#: The share of true neighbours that the probed lists have to hold.
WANTED = 0.98


@dataclass(frozen=True)
class Commit:
    """What a store's last generation says."""

    version: int
    generation: int
    probes: int


def _path(path: str, kind: str, generation: int) -> str:
    return f"{path}/{kind}/generation={generation}"


def current(spark: SparkSession, path: str) -> Commit | None:
    """The last commit; None if there is none of this version."""
    numbers = [int(n) for n in folders.names(spark, f"{path}/commits") if n.isdigit()]
    if not numbers:
        return None
    row = spark.read.text(f"{path}/commits/{max(numbers)}").first()
    held = Commit(**json.loads(row[0]))
    return held if held.version == VERSION else None


def _commit(spark: SparkSession, path: str, commit: Commit) -> None:
    staged = f"{path}/staged-{commit.generation}"
    spark.createDataFrame([(json.dumps(asdict(commit)),)], "value string").coalesce(1).write.mode("overwrite").text(staged)
    folders.filesystem(spark, f"{path}/commits")[0].mkdirs(folders.filesystem(spark, f"{path}/commits")[1])
    folders.rename(spark, staged, f"{path}/commits/{commit.generation}")


# -- the queue


def pending(log: DataFrame) -> DataFrame:
    """(id, operation, generation, since) of a log of changes (id, operation, at): the last operation of each id, how many there were, and the time of the last."""
    last = F.max_by("operation", F.struct("at", "operation"))
    return log.groupBy("id").agg(last.alias("operation"), F.count("*").alias("generation"), F.max("at").alias("since"))


def complete(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue without what was done, unless it was queued again meanwhile."""
    return queue.join(done.select("id", "generation"), ["id", "generation"], "left_anti")


# -- writing


def _write_text(rows: DataFrame, path: str, generation: int) -> None:
    spark = rows.sparkSession
    small_batches(spark)
    # a document's tokens meet in its own row, and each task writes a file of its own in each folder: nothing is shuffled or sorted
    found = rows.select("id", "project", all_tokens("document").alias("tokens")).mapInArrow(places, POSTINGS)
    bucketed = found.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, str(BUCKETS))
    try:
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(_path(path, "postings", generation))
    finally:
        spark.conf.set(WRITERS, before)
    rows.select("id", F.size(tokens("document")).alias("length")).write.mode("overwrite").parquet(_path(path, "lengths", generation))


def _listed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(list, id, project, embedding) of the rows with a usable vector of the centroids' size."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # MOST_LISTS vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = shared.value
        for batch in batches:
            at, vectors = usable(batch.column("embedding"), units.shape[1])
            if len(at):
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array((vectors @ units.T).argmax(1), pa.int32()), own.column("id"), own.column("project"), own.column("embedding").cast(pa.list_(pa.float32()))], ["list", "id", "project", "embedding"])

    return rows.select("id", "project", "embedding").where("embedding is not null").mapInArrow(assign, "list int, id string, project string, embedding array<float>")


def usable(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit vectors of the lists that have a direction and the size."""
    at = [i for i, v in enumerate(column.to_pylist()) if v is not None and len(v) == size and None not in v]
    rows = np.array([column[i].as_py() for i in at], np.float64).reshape(len(at), size)
    norms = np.linalg.norm(rows, axis=1)
    ok = np.isfinite(norms) & (norms > 0)
    return np.array(at, np.int64)[ok], rows[ok] / norms[ok, None]


def _write_vectors(rows: DataFrame, path: str, generation: int, centroids: np.ndarray | None) -> None:
    found = _listed(rows, centroids) if centroids is not None else rows.where("false").select(F.lit(0).alias("list"), "id", "project", F.col("embedding").cast("array<float>").alias("embedding"))
    found.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(_path(path, "vectors", generation))


def fitted(memories: DataFrame, sample: int = SAMPLE, most: int = MOST_LISTS) -> np.ndarray | None:
    """Unit centroids of the most frequent vector size, by spherical k-means on a bounded sample; as many as the root of the number of vectors."""
    rows = memories.where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("v"))
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if size is None or size["n"] <= 0:
        return None
    drawn = rows.where(F.size("v") == size["n"]).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    units = usable(drawn, size["n"])[1]
    if not len(units):
        return None
    k = min(most, len(units), max(1, round(size["rows"] ** 0.5)))
    centres = units[np.linspace(0, len(units) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        nearest_to = (units @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest_to, units)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1)[:, None], centres)
    return centres


def _centroids(spark: SparkSession, path: str) -> np.ndarray | None:
    held = sorted((r["list"], list(r["v"])) for r in spark.read.parquet(f"{path}/centroids").collect())  # MOST_LISTS at most
    return np.array([v for _, v in held]) if held else None


def probes_needed(path: str, memories: DataFrame, centroids: np.ndarray, wanted: float = WANTED, asked: int = ASKED) -> int:
    """Lists to probe, so that they hold the wanted share of the true neighbours of sampled vectors."""
    spark = memories.sparkSession
    rows = memories.where(F.size("embedding") == centroids.shape[1]).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(asked)
    # the sample's rows are ``asked`` at most
    sample = [(i, [float(x) for x in r["embedding"]]) for i, r in enumerate(rows.select("embedding").collect()) if r["embedding"] is not None and None not in r["embedding"]]
    queries = spark.createDataFrame([(i, v, []) for i, v in sample], "query_id long, embedding array<double>, scope array<string>")
    lists = spark.read.parquet(_path(path, "vectors", 0)).select("id", "list")
    found = nearest(queries, memories, NEIGHBOURS).join(lists, "id").select("query_id", "list").collect()
    by = dict(sample)
    ranks = []
    order: dict[int, np.ndarray] = {}
    for r in found:
        if r["query_id"] not in order:
            order[r["query_id"]] = np.argsort(np.argsort(-(centroids @ np.array(by[r["query_id"]])), kind="stable"), kind="stable")
        ranks.append(int(order[r["query_id"]][r["list"]]) + 1)
    return int(np.quantile(ranks, wanted, method="higher")) if ranks else 1


def build(memories: DataFrame, path: str, wanted: float = WANTED, text: bool = True, vectors: bool = True) -> Commit:
    """A store of all visible rows, in place of any there is; without its postings or its vectors if only one is searched."""
    spark = memories.sparkSession
    folders.remove(spark, path)
    seen = memories.where(visible())
    centroids = fitted(seen) if vectors else None
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(centroids if centroids is not None else [])], "list int, v array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    if text:
        _write_text(seen, path, 0)
    _write_vectors(seen, path, 0, centroids)
    seen.select("id", F.lit(0).alias("before")).where("false").write.parquet(_path(path, "dead", 0))
    commit = Commit(VERSION, 0, probes_needed(path, seen, centroids, wanted) if centroids is not None else 1)
    _commit(spark, path, commit)
    return commit


def refresh(memories: DataFrame, queue: DataFrame, path: str, within: Column | None = None) -> DataFrame:
    """Bring the queued ids up to date: (id, generation) of what was done.

    The rows of upserted ids are read, those last changed before the first queued change excepted. ``within`` is a condition
    that all rows of queued ids meet, on a partition column, say: files that can't meet it aren't read. An id that is deleted, hidden or not there any more loses its entries.
    A store that isn't there, or of another version, is built anew.
    """
    spark = memories.sparkSession
    held = current(spark, path)
    if held is None:
        build(memories, path)
        return queue.select("id", "generation")
    generation = held.generation + 1
    since = queue.where(F.col("operation") == UPSERT).agg(F.min("since")).first()[0]
    # the queue is read again for each table: it is written once
    queue.select("id", "operation", "generation").write.mode("overwrite").parquet(f"{path}/queue/{generation}")
    asked = spark.read.parquet(f"{path}/queue/{generation}")
    changed = memories.where(F.col("updated_at") >= F.lit(str(since)).cast(memories.schema["updated_at"].dataType)) if since is not None else memories.where("false")
    if within is not None:
        changed = changed.where(within)
    rows = changed.where(visible()).join(asked.where(F.col("operation") == UPSERT).select("id"), "id", "left_semi")
    if folders.exists(spark, f"{path}/postings"):
        _write_text(rows, path, generation)
    _write_vectors(rows, path, generation, _centroids(spark, path))
    asked.select("id", F.lit(generation).alias("before")).write.mode("overwrite").parquet(_path(path, "dead", generation))
    _commit(spark, path, Commit(VERSION, generation, held.probes))
    return asked.select("id", "generation")


# -- reading


def _live(spark: SparkSession, path: str, kind: str, schema: str, upto: int, pick: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Entries of a kind that no later generation replaces or removes; ``pick`` chooses among all before they meet the changed ids."""
    rows = spark.read.schema(f"{schema}, generation int").option("basePath", f"{path}/{kind}").parquet(*(_path(path, kind, g) for g in range(upto + 1)))
    rows = pick(rows)
    dead = spark.read.schema("id string, before int").parquet(*(_path(path, "dead", g) for g in range(upto + 1))).groupBy("id").agg(F.max("before").alias("before"))
    # the changed ids alone: Spark broadcasts them where they are few, and sorts both sides where they aren't
    return rows.join(dead, (rows["id"] == dead["id"]) & (F.col("generation") < F.col("before")), "left_anti")


def postings(spark: SparkSession, path: str, commit: Commit) -> DataFrame:
    """(term, id, project, length, at, bucket)."""
    return _live(spark, path, "postings", f"{POSTINGS}, bucket int", commit.generation)


def text_top(queries: DataFrame, path: str, k: int, config: Config | None = None, digits: int | None = 6) -> DataFrame:
    """(query_id, id, score, rank from 0): the best documents of each query's words, of the store alone.

    Only the folders of the queries' words are read.
    """
    spark, config = queries.sparkSession, config or Config()
    commit = current(spark, path)
    asked = queries.select("query_id", "scope", F.explode(F.array_distinct(tokens("text"))).alias("term")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
    # the words' postings alone meet the changed ids, dealt by document: a task has all of a document's that count
    words = asked.select("term").distinct()
    pick = lambda rows: rows.where(F.col("bucket").isin(buckets)).join(F.broadcast(words), "term", "left_semi").select("term", "id", "project", "length", F.size("at").alias("tf"), "generation").repartition("id")
    found = _live(spark, path, "postings", f"{POSTINGS}, bucket int", commit.generation, pick)
    frequency = found.groupBy("term").agg(F.count("*").alias("df"))
    stats = _live(spark, path, "lengths", "id string, length int", commit.generation).agg(F.count("*").alias("documents"), F.avg("length").alias("average"))
    tf, k1, b = F.col("tf"), config.bm25_k1, config.bm25_b
    weight = idf(F.col("documents"), F.col("df")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("average")))
    weighted = found.join(F.broadcast(frequency), "term").join(F.broadcast(stats), F.lit(True)).select("term", "id", "project", weight.alias("weight"))
    wide = F.coalesce(F.size("scope"), F.lit(0)) <= 0
    hits = weighted.join(F.broadcast(asked), "term").where(wide | F.array_contains("scope", F.col("project"))).groupBy("query_id", "id").agg(F.sum("weight").alias("score"))
    hits = hits if digits is None else hits.withColumn("score", F.round("score", digits))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")) - 1).where(F.col("rank") < k)


def near_top(queries: DataFrame, path: str, k: int, probes: int | None = None, digits: int | None = 6) -> DataFrame:
    """(query_id, id, distance, rank from 0): near memories of each query, from the lists nearest to it.

    Distances are exact; a neighbour in a list that isn't probed is missed. ``probes`` None takes the number that the
    store was built for. Only the folders of probed lists are read, and each list meets the queries that probe it.
    """
    spark = queries.sparkSession
    small_batches(spark)
    commit = current(spark, path)
    centroids = _centroids(spark, path)
    out = None
    if centroids is not None:
        asked = queries.select("query_id", "embedding", "scope").where(F.size("embedding") == centroids.shape[1])
        for part in passes(asked, 8 * F.size("embedding") + 64):
            found = _probe(part, spark, path, commit, centroids, k, probes or commit.probes, digits)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id string, distance double, rank int")
    return out.drop("k").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")) - 1).where(F.col("rank") < k)


def _probe(rows: list, spark: SparkSession, path: str, commit: Commit, centroids: np.ndarray, k: int, probes: int, digits: int | None) -> DataFrame:
    size = centroids.shape[1]
    at, units = usable(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), size)
    own = [rows[i] for i in at]
    lists = np.argsort(-(units @ centroids.T), axis=1, kind="stable")[:, :probes]
    of_list = {int(x): np.flatnonzero((lists == x).any(1)) for x in np.unique(lists)}
    kind = "long" if rows and type(rows[0]["query_id"]) is int else "string"
    shared = spark.sparkContext.broadcast((units, of_list, [set(r["scope"] or ()) for r in own], [r["query_id"] for r in own]))
    held = _live(spark, path, "vectors", "id string, project string, embedding array<float>, list int", commit.generation).where(F.col("list").isin(list(of_list)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, of_list, scopes, names = shared.value
        best = Best([k] * len(names), largest=False)
        for batch in batches:
            at, vectors = usable(batch.column("embedding"), size)
            ids, projects = np.array(batch.column("id").to_pylist(), object), batch.column("project").to_pylist()
            numbers = batch.column("list").to_numpy()[at]
            for number in np.unique(numbers).tolist():
                asking, mine = of_list.get(number), np.flatnonzero(numbers == number)
                if asking is None:
                    continue
                away = 1.0 - units[asking] @ vectors[mine].T
                if digits is not None:
                    away = np.abs(np.round(away, digits))
                for q, row in zip(asking.tolist(), away, strict=True):
                    inside = np.array([not scopes[q] or projects[at[i]] in scopes[q] for i in mine])
                    if inside.any():
                        best.add(q, row[inside], ids[at[mine[inside]]])
        yield from best.batches(names, [k] * len(names), "distance", pa.int64() if kind == "long" else pa.string())

    return held.select("id", "project", "embedding", "list").mapInArrow(run, f"query_id {kind}, id string, distance double, k int")
