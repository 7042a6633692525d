"""Centroid clusters of integer vectors: exact results from float32 matrix products.

Vectors with exactly ``SIZE`` components, none null or non-finite, become integers,
floor(256 * x). A round assigns each vector to its nearest centroid (squared Euclidean
distance, the smaller number of equally near ones) and moves each centroid to the
floor of its vectors' mean.

A task multiplies a block of vectors with all centroids in float32. Whatever order a
matrix product adds in, its error is at most n * u / (1 - n * u) times the sum of the
products' magnitudes, which the two norms' product bounds (Cauchy-Schwarz); with the
rounding of the inputs that gives an interval around each distance. Centroids whose
interval begins beyond the least end can't be nearest; the others' distances are taken
in 64-bit integers. Vectors and centroids with components beyond ``LARGE`` are compared
in Python's integers instead, which have no bound.

Only the centroids and their counts and sums (``K * SIZE`` numbers) pass through the
driver; each task adds up its own vectors first. The table is read once a round.

Cases: fewer vectors than centroids give as many centroids as there are vectors; a null
vec_id is assigned but never starts a centroid; repeated rows count each, and of equal
ids the row with the lesser components starts a centroid first; distances and sums
beyond a long are stated as the greatest long; other columns are ignored; an empty
table, or one that starts no centroid, gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, plain_scan

K, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, 2
#: Components from here on, and vectors and centroids that have them, are Python's integers: below, no distance leaves 64 bits.
LARGE = 1 << 26
#: Vectors that are compared at once.
BLOCK = 1024
#: Relative error of one float32 operation, and of the double operations that bound it, with room to spare.
UNIT, SLACK = 2.0**-24, 1 + 2.0**-30
GREATEST = (1 << 63) - 1
LIMB = 32


def kept(vectors: DataFrame, path: str = "vec_id", vector: str = "embedding", size: int = SIZE) -> DataFrame:
    """(id, v) of the vectors that have integers, v as doubles."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(path).alias("id"), v.alias("v")).where((F.size("v") == size) & finite)


def integers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 * x) of each row, and which rows don't fit (their integers are zeros here)."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    large = (np.abs(scaled) >= LARGE).any(1)
    scaled[large] = 0
    return scaled.astype(np.int64), large


def integer(x: float) -> int:
    """floor(256 * x) without any bound."""
    n, d = x.as_integer_ratio()
    return n * SCALE // d


class Centroids:
    """Integer centroids, and what screening needs of them."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.rows = rows
        self.large = any(abs(x) >= LARGE for row in rows for x in row)
        if rows and not self.large:
            self.whole = np.array(rows, np.int64).reshape(len(rows), -1)
            self.single = self.whole.astype(np.float32)
            self.squares = (self.whole**2).sum(1).astype(np.float64)
            self.norms = np.sqrt(self.squares)

    def screened(self, v: np.ndarray) -> np.ndarray:
        """Which centroids may be nearest to each integer vector."""
        n = v.shape[1] + 2  # the products' roundings, and those of both inputs
        share = n * UNIT / (1 - n * UNIT) * SLACK
        product = (v.astype(np.float32) @ self.single.T).astype(np.float64)
        norms = np.sqrt((v**2).sum(1).astype(np.float64))
        # distances without the vector's own square, and what they may be off by: twice the product's error, and double roundings
        about = self.squares - 2 * product
        off = 2 * share * norms[:, None] * self.norms + 2.0**-48 * (self.squares + 2 * np.abs(product)) + 2.0**-20
        return about - off <= (about + off).min(1, keepdims=True)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cluster and exact distance of each integer vector; ties go to the smaller number."""
        cluster, distance = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
        for at in range(0, len(v), BLOCK):
            block = v[at : at + BLOCK]
            row, number = np.nonzero(self.screened(block))
            exact = ((block[row] - self.whole[number]) ** 2).sum(1)
            order = np.lexsort((number, exact, row))
            first = order[np.searchsorted(row[order], np.arange(len(block)))]
            cluster[at : at + BLOCK], distance[at : at + BLOCK] = number[first], exact[first]
        return cluster, distance

    def nearest_of(self, v: list[int]) -> tuple[int, int]:
        """The same for one vector, in integers without a bound."""
        distance, cluster = min((sum((a - b) ** 2 for a, b in zip(v, row, strict=True)), i) for i, row in enumerate(self.rows))
        return cluster, distance

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, dict[int, list[int]]]:
        """Clusters, distances, integer vectors, and those of rows that don't fit."""
        v, large = integers(x)
        if self.large:
            large[:], v = True, np.zeros_like(v)
        odd = {int(i): [integer(float(y)) for y in x[i]] for i in np.flatnonzero(large)}
        if self.large:
            cluster, distance = np.zeros(len(v), np.int64), [0] * len(v)
        else:
            cluster, exact = self.nearest(v)
            distance = exact.tolist()
        for i, row in odd.items():
            cluster[i], distance[i] = self.nearest_of(row)
        return cluster, distance, v, odd


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def starts(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The vectors whose hashed ids are least, in that order."""
    rows = vectors.where("id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)).orderBy("h", "v").limit(k).select("v").collect()
    return [[integer(x) for x in r["v"]] for r in rows]


def limbs(x: int) -> list[int]:
    """An integer as digits of ``LIMB`` bits, the last one signed, so that sums of digits stay within a long."""
    out = []
    while not -(1 << LIMB) <= x < 1 << LIMB:
        out.append(x & ((1 << LIMB) - 1))
        x >>= LIMB
    return [*out, x]


def moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """The centroids after one round; those without vectors stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # k * SIZE integers
    width = len(centroids.rows[0])

    def tally(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        total = [[0] * (width + 1) for _ in now.rows]  # Python's integers; the last place counts
        for batch in batches(rows):
            cluster, _, v, odd = now.assigned(_matrix(batch))
            order = np.argsort(cluster, kind="stable")
            first = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            # rows of a batch are few and components below LARGE: the batch's sums fit 64 bits
            for i, sums, n in zip(cluster[order][first].tolist(), np.add.reduceat(v[order], first).tolist(), np.diff(first, append=len(order)).tolist(), strict=True):
                total[i] = [a + b for a, b in zip(total[i], [*sums, n], strict=True)]
            for at, row in odd.items():  # zeros in v
                i = int(cluster[at])
                total[i][:width] = [a + b for a, b in zip(total[i], row)]
        found = [(i, j, k, x) for i, row in enumerate(total) if row[-1] for j, y in enumerate(row) for k, x in enumerate(limbs(y))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["c", "j", "limb", "x"])

    sums: dict[tuple[int, int], int] = {}
    for r in vectors.mapInArrow(tally, "c int, j int, limb int, x long").groupBy("c", "j", "limb").agg(F.sum("x").alias("x")).collect():
        sums[r["c"], r["j"]] = sums.get((r["c"], r["j"]), 0) + (r["x"] << LIMB * r["limb"])
    return Centroids([[sums[i, j] // sums[i, width] for j in range(width)] if (i, width) in sums else row for i, row in enumerate(centroids.rows)])


def _long(total: Column) -> Column:
    return F.least(total, F.lit(GREATEST)).cast("long")


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, path: str = "vec_id", vector: str = "embedding", size: int = SIZE) -> tuple[DataFrame, Centroids]:
    """(vec_id, cluster, distance) after the rounds, and the final centroids."""
    found = kept(plain_scan(vectors, path, vector), path, vector, size)
    centroids = Centroids(starts(found, k, seed))
    if not centroids.rows:
        return found.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), centroids
    for _ in range(rounds):
        centroids = moved(found, centroids)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            cluster, distance, _, _ = shared.value.assigned(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster, pa.int32()), pa.array([min(d, GREATEST) for d in distance], pa.int64())], ["id", "cluster", "distance"])

    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(assign, f"id {kind}, cluster int, distance long"), centroids


def cluster_report(vectors: DataFrame) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    found, centroids = clusters(vectors)
    # at most k rows: a sum for each cluster
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    rows = [(i, min(s, GREATEST), min(sum(sums.values()), GREATEST), digest(centroids.rows[i])) for i, s in sums.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
