"""Embedding near-duplicates by product quantisation.

Vectors with one label link when their cosine is ``least`` or more. Equal vectors
of a label are one class from the start. Coarse inverted lists and codebooks for
the residuals in subspaces are fitted on a bounded sample of classes; every class
is indexed. A query probes its nearest lists (of those that the plane between two
centres leaves within reach), looks up the asymmetric distances to the codes, and
reranks by exact double-precision cosine whatever the lookup, with the code's own
error allowed for, doesn't rule out. So the index can lose a link only by too few
probes (by none without a limit of them); recall is measured against brute force in the
tests.

No pair leaves a task: a block of a list adds up link counts and a spanning forest.
Blocks have bounded sides; a longer list is cut into several.

Cases: vectors that are null, empty or zero, or hold nulls or non-finite numbers,
and rows without a label link with nothing; vectors of different lengths don't
link; repeated rows are vectors of their own; a null id has a null component and
is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, stash
from .components import components

LEAST_COSINE = 0.93
#: Classes that the lists and codebooks are fitted on at most.
SAMPLE = 20_000
#: Classes a list is meant to hold (over all labels), lists at most, lists that a query probes at most.
LIST_SIZE, MOST_LISTS, PROBES = 512, 4096, 24
SUBSPACES, CODES = 8, 64
#: Sides of a block.
MEMBERS, QUERIES = 1024, 4096


def kmeans(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``k`` groups; deterministic for one order of points."""
    k = max(1, min(k, len(points)))
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        of = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        counts = np.bincount(of, minlength=k)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    for at in range(0, len(points), 4096):
        out[at : at + 4096] = squared(points[at : at + 4096], centres).argmin(1)
    return out


class Index:
    """Coarse centres, and codebooks for the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.centres = kmeans(sample, lists)
        residuals = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(residuals[:, c], CODES) for c in self.cuts]

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code, and distance from its code of each vector."""
        of = nearest(units, self.centres)
        residuals = units - self.centres[of]
        codes = np.stack([nearest(residuals[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], 1)
        guess = np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], 1)
        return of, codes.astype(np.uint8), np.linalg.norm(residuals - guess, axis=1)

    def probes(self, unit: np.ndarray, own: int, reach: float, most: int) -> np.ndarray:
        """The nearest lists, the own one first, that can hold a vector within reach."""
        away = squared(unit[None], self.centres)[0]
        between = np.sqrt(squared(self.centres[own][None], self.centres)[0])
        with np.errstate(divide="ignore", invalid="ignore"):
            to_plane = (away - away[own]) / (2 * between)
        can = np.flatnonzero((to_plane <= reach + 1e-9) & (np.arange(len(away)) != own))
        return np.concatenate([[own], can[np.argsort(away[can], kind="stable")][: most - 1]])

    def lookup(self, units: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries from the coded members of one list."""
        residuals = units - self.centres[cell]
        total = np.zeros((len(units), len(codes)))
        for s, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            total += squared(residuals[:, c], b)[:, codes[:, s]]
        return total


def _vectors(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as doubles, scaled alike, with their content's hash; nulls for the others."""
    for batch in batches(rows):
        held, content = [], []
        for v in batch.column("v").to_pylist():
            x = np.array(v, np.float64) + 0.0 if v and None not in v else np.zeros(1)
            ok = np.isfinite(x).all() and x.any()
            content.append(xxhash.xxh3_128_digest(x.tobytes()) if ok else None)
            # by a power of two, so that the greatest component is near one and no square over- or underflows
            held.append(np.ldexp(x, -np.frexp(np.abs(x).max())[1]).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(content, pa.binary()), pa.array(held, pa.binary())], ["id", "label", "content", "v"])


def padded(held: list[bytes], dim: int) -> np.ndarray:
    """Vectors of a common length: zeros at the end change no cosine."""
    out = np.zeros((len(held), dim))
    for row, v in zip(out, held, strict=True):
        row[: len(v) // 8] = np.frombuffer(v)
    return out


def near_embeddings(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST_COSINE, probes: int | None = PROBES, sample: int = SAMPLE, list_size: int = LIST_SIZE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept. Without ``probes``, each query meets every list within reach: exact, but quadratic where vectors fill their space."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    rows = stash(rows.mapInArrow(_vectors, "id long, label string, content binary, v binary"))
    usable = rows.where("content is not null and label is not null and id is not null")
    classes = usable.groupBy("label", "content").agg(F.min("id").alias("leader"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = stash(classes)
    total, longest = classes.agg(F.count("*"), F.max(F.length("v"))).first()
    reach = math.sqrt(2 - 2 * least)
    if total:
        dim = longest // 8
        drawn = padded([bytes(r.v) for r in classes.orderBy(F.xxhash64("content"), "leader").limit(sample).select("v").collect()], dim)
        lists = min(MOST_LISTS, max(1, total // list_size))
        index = spark.sparkContext.broadcast(Index(drawn / np.linalg.norm(drawn, axis=1, keepdims=True), lists))

    def place(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batches_):
            full = padded(batch.column("v").to_pylist(), dim)
            units = full / np.linalg.norm(full, axis=1, keepdims=True)
            of, codes, off = index.value.encode(units)
            to = [index.value.probes(u, int(c), reach, probes or len(index.value.centres)).tolist() for u, c in zip(units, of, strict=True)]
            columns = [batch.column("label"), batch.column("leader"), batch.column("copies"), batch.column("v"), pa.array(of, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.array(to, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "id", "copies", "v", "own", "code", "off", "probes"])

    def block(members: pd.DataFrame) -> pd.DataFrame:
        """Link counts (b = 1) and forest links (b = 0) of the queries and members of one block of a list."""
        asks, holds = members[members.asks], members[~members.asks]
        out: list[tuple[int, int, int]] = []
        if len(asks) and len(holds):
            cell = int(members.cell.iloc[0])
            x, y = padded(list(asks.v), dim), padded(list(holds.v), dim)
            nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
            ids, owners = asks.id.to_numpy(), holds.id.to_numpy()
            codes = np.frombuffer(b"".join(holds.code), np.uint8).reshape(len(holds), -1)
            bound = (reach + holds.off.to_numpy() + 1e-9) ** 2
            same = asks.v.str.len().to_numpy()[:, None] == holds.v.str.len().to_numpy()[None]
            i, j = np.nonzero((index.value.lookup(x / nx[:, None], cell, codes) <= bound) & same & (ids[:, None] != owners[None]))
            cosine = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j])
            i, j = i[cosine >= least], j[cosine >= least]
            # each pair counts once: where the larger id asks, or from the other side if that one doesn't probe this id's list
            counted = ids[i] > owners[j]
            probed, own = holds.probes.tolist(), asks.own.tolist()
            for k in np.flatnonzero(~counted):
                counted[k] = own[i[k]] not in probed[j[k]]
            i, j = i[counted], j[counted]
            adds: dict[int, int] = {}
            for who, far in ((ids[i], holds.copies.to_numpy()[j]), (owners[j], asks.copies.to_numpy()[i])):
                names, at = np.unique(who, return_inverse=True)
                for n, c in zip(names.tolist(), np.bincount(at, far, len(names)).astype(int).tolist(), strict=True):
                    adds[n] = adds.get(n, 0) + c
            out += [(n, c, 1) for n, c in adds.items()]
            root: dict[int, int] = {}

            def find(n: int) -> int:
                while root.get(n, n) != n:
                    root[n] = root.get(root[n], root[n])
                    n = root[n]
                return n

            for a, b in zip(ids[i].tolist(), owners[j].tolist(), strict=True):
                ra, rb = find(a), find(b)
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
                    out.append((a, b, 0))
        return pd.DataFrame(out, columns=["a", "b", "counts"]).astype("int64")

    if total:
        placed = stash(classes.mapInArrow(place, "label string, id long, copies long, v binary, own int, code binary, off double, probes array<int>"))
        asks = placed.withColumn("cell", F.explode("probes")).withColumn("asks", F.lit(True))
        both = asks.unionByName(placed.withColumn("cell", F.col("own")).withColumn("asks", F.lit(False)))
        sizes = both.groupBy("label", "cell").agg(F.ceil(F.count_if("asks") / QUERIES).alias("q"), F.ceil(F.count_if(~F.col("asks")) / MEMBERS).alias("m"))
        cut = both.join(sizes.where("m > 0"), ["label", "cell"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.when(F.col("asks"), F.col("q")).otherwise(F.col("m"))))
        cut = cut.withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("asks"), F.col("m")).otherwise(F.col("q")) - 1)))
        cut = cut.withColumn("pq", F.when(F.col("asks"), F.col("mine")).otherwise(F.col("theirs"))).withColumn("pm", F.when(F.col("asks"), F.col("theirs")).otherwise(F.col("mine"))).drop("mine", "theirs", "q", "m")
        found = stash(cut.groupBy("label", "cell", "pq", "pm").applyInPandas(block, "a long, b long, counts long"))
    else:
        found = spark.createDataFrame([], "a long, b long, counts long")
    counts = found.where("counts = 1").groupBy(F.col("a").alias("leader")).agg(F.sum("b").alias("far"))
    roots = components(found.where("counts = 0").select("a", "b")).select(F.col("node").alias("leader"), "component")
    about = classes.select("label", "content", "leader", "copies").join(counts, "leader", "left").join(roots, "leader", "left")
    about = stash(about.select("label", "content", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "leader").alias("component")))
    out = rows.select("id", "label", F.when(F.col("id").isNotNull(), F.col("content")).alias("content")).join(about, ["label", "content"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
