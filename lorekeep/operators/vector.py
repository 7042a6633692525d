"""Cosine similarity and exact nearest neighbours for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that a task may hold; more queries go in several passes.
QUERY_BYTES = 64 << 20
#: Rows and bytes of an Arrow batch at most: what a worker holds doesn't grow with its partition.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let no worker get more at once; the operators that scan a table in workers ask for it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine in double precision; 0 for vectors that are null, empty, zero, of unequal length or not finite."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    wide = lambda v: F.transform(v, lambda e: e.cast("double"))
    add = lambda s, e: s + e
    dot = F.aggregate(F.zip_with(wide(x), wide(y), lambda p, q: p * q), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(wide(v), F.lit(0.0), lambda s, e: s + e * e))
    value = F.try_divide(dot, norm(x) * norm(y))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0) & finite, value).otherwise(0.0)


class Best:
    """The best ids of each query among those that a task has seen; of equals the lesser ids."""

    def __init__(self, ks: list[int], largest: bool) -> None:
        self.ks, self.sign = ks, -1.0 if largest else 1.0
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.sizes: dict[int, int] = {}
        #: The worst value among as many as are wanted: what is worse can't be among the best.
        self.bars: dict[int, float] = {}

    def add(self, q: int, values: np.ndarray, ids: np.ndarray) -> None:
        if q in self.bars:
            near = values * self.sign <= self.bars[q]
            if not near.any():
                return
            values, ids = values[near], ids[near]
        self.held.setdefault(q, []).append((values, ids))
        self.sizes[q] = self.sizes.get(q, 0) + len(values)
        if self.sizes[q] > 2 * self.ks[q] + 1024:
            self.cut(q)

    def cut(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        values, ids = (np.concatenate(c) for c in zip(*self.held[q], strict=True))
        if len(values) > self.ks[q]:
            key = values * self.sign
            # all that may be among the best, then ordered by their ids too
            near = np.flatnonzero(key <= np.partition(key, self.ks[q] - 1)[self.ks[q] - 1]) if self.ks[q] > 0 else np.empty(0, np.int64)
            near = near[np.lexsort((ids[near].astype(str), key[near]))][: self.ks[q]]
            values, ids = values[near], ids[near]
            if len(values):
                self.bars[q] = float((values * self.sign).max())
        self.held[q], self.sizes[q] = [(values, ids)], len(values)
        return values, ids

    def batches(self, names: list, ks: list[int], value: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for q in list(self.held):
            values, ids = self.cut(q)
            yield pa.RecordBatch.from_arrays([pa.array([names[q]] * len(ids), kind), pa.array(ids, pa.string()), pa.array(values, pa.float64()), pa.array([ks[q]] * len(ids), pa.int32())], ["query_id", "id", value, "k"])
            del self.held[q]


def passes(rows: DataFrame, size: Column) -> Iterator[list]:
    """Rows in lists of about ``QUERY_BYTES``, by the size that each is said to have; each list is one partition and one job."""
    total = rows.agg(F.sum(size)).first()[0]
    if not total:
        return
    n = -(-int(total) // QUERY_BYTES)
    held: list = []
    # a partition comes to the driver at a time
    for r in rows.repartition(n).select("*", F.spark_partition_id().alias("__pass")).toLocalIterator():
        if held and r["__pass"] != held[-1]["__pass"]:
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def nearest(queries: DataFrame, memories: DataFrame, k: str | int = "candidates", digits: int | None = 6) -> DataFrame:
    """(query_id, id, distance, rank from 0): the exact nearest memories of each query, within its scope.

    queries: query_id, embedding, scope (project names, empty or null for all), and k if named. The memory table is read
    once: each task compares its rows with all queries as one matrix product, keeps the best of each query it has, and
    only those meet in the window that ranks them. Rows without a usable vector are skipped.
    """
    small_batches(queries.sparkSession)
    most = k if isinstance(k, int) else None
    asked = queries.select("query_id", "embedding", "scope", *([] if most else [F.col(k).alias("k")])).where("embedding is not null")
    out = None
    for part in passes(asked, 8 * F.size("embedding") + 64):
        found = _scan(part, memories, most, digits)
        out = found if out is None else out.unionByName(found)
    if out is None:
        spark = queries.sparkSession
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id string, distance double, k int, rank int").drop("k")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(order) - 1).where("rank < k").drop("k")


def _scan(rows: list, memories: DataFrame, most: int | None, digits: int | None) -> DataFrame:
    spark = memories.sparkSession
    dims = sorted({len(r["embedding"]) for r in rows})
    by_dim = {}
    for d in dims:
        own = [r for r in rows if len(r["embedding"]) == d]
        vectors = np.array([r["embedding"] for r in own], np.float64)
        norms = np.linalg.norm(vectors, axis=1)
        ok = np.isfinite(norms) & (norms > 0)
        own = [r for r, good in zip(own, ok, strict=True) if good]
        by_dim[d] = (vectors[ok] / norms[ok, None], [r["query_id"] for r in own], [set(r["scope"] or ()) for r in own], [most or r["k"] for r in own])
    shared = spark.sparkContext.broadcast(by_dim)
    id_type = type(rows[0]["query_id"])
    kind = "long" if id_type is int else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(ks, largest=False) for d, (_, _, _, ks) in shared.value.items()}
        for batch in batches:
            ids, names = np.array(batch.column("id").to_pylist(), object), [p or "" for p in batch.column("project").to_pylist()]
            projects, of = np.unique(np.array(names), return_inverse=True)
            inside = {p: of == i for i, p in enumerate(projects.tolist())}
            held = batch.column("embedding").to_pylist()
            for d, (units, _, scopes, ks) in shared.value.items():
                at = [i for i, v in enumerate(held) if v is not None and len(v) == d and None not in v]
                if not at:
                    continue
                rows = np.array([held[i] for i in at], np.float64)
                norms = np.linalg.norm(rows, axis=1)
                ok = np.isfinite(norms) & (norms > 0)
                own, rows = np.array(at)[ok], rows[ok] / norms[ok, None]
                away = 1.0 - units @ rows.T
                if digits is not None:
                    away = np.abs(np.round(away, digits))  # no negative zeros
                for q, scope in enumerate(scopes):
                    mine = np.flatnonzero(np.any([inside[p][own] for p in scope if p in inside], axis=0)) if scope and any(p in inside for p in scope) else np.arange(0 if scope else len(own))
                    if len(mine):
                        best[d].add(q, away[q, mine], ids[own[mine]])
        for d, (_, names, _, ks) in shared.value.items():
            yield from best[d].batches(names, ks, "distance", pa.int64() if kind == "long" else pa.string())

    return memories.select("id", "project", "embedding").where("embedding is not null").mapInArrow(run, f"query_id {kind}, id string, distance double, k int")
