"""MinHash near-duplicates with odd sketches.

A document is the set of its distinct five-word shingles (A-Z lower-cased; fewer
words: the whole sequence is its one shingle). Equal sets are one class from the
start. Each class has ``BANDS * ROWS`` MinHash samples; bands of them bring
candidates together, and the samples fold into a parity bitmap, the odd sketch,
whose XOR population count tells how many samples differ: precisely so for high
similarities. Candidates that pass it are confirmed on their whole sets.

Candidates are never all pairs of a bucket. Each member first meets its bucket's least
and greatest member; the confirmed links give components. A bucket that then holds one
component needs no more. In the others, sketches of different components are compared
within a task, which returns no more than a spanning forest of those near enough; its
trees are clusters. Members of a cluster then meet with their whole sets in a task,
which finds every link between components and again returns a spanning forest. Both
steps cut large groups into blocks of bounded size. Links within a component can't
change the result, so none that matters is lost; a pair at 0.85 or more shares no band
with probability below 1e-6.

Cases: null and empty texts, and texts of white space alone, have no shingles and
link with nothing; repeated rows are copies; a null id links with nothing, has a
null component and is kept; an empty table gives an empty result; other columns
are ignored.
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

from .anchors import mix, rolling
from .common import batches, body, stash, words
from .components import components

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
BANDS, ROWS = 26, 5
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch.
SKETCH = 512
#: A pair at the threshold falls short of this estimate with six standard deviations.
LEAST_ESTIMATE = PERCENT / 100 - 6 * math.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / SAMPLES)
#: The population count of an XOR that stands for that estimate, with as much again for the folding.
MOST_BITS_APART = int(SKETCH / 2 * (1 - math.exp(-2 * (2 * SAMPLES * (1 - LEAST_ESTIMATE)) / SKETCH)) + 4 * math.sqrt(SKETCH) / 2)
#: Members of a bucket that are compared with each other in one task at most.
BLOCK = 2048
#: Classes of fewer copies are never frequent; of those with a greater share of the rows than one in so many, there are no more than that.
FEW, FREQUENT = 64, 10_000
#: Bits of the filter that finds the documents to confirm: 8 MB however many there are.
FILTER_BITS = 26

_draw = np.random.default_rng(20240229)
FACTORS = _draw.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _draw.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    held = words(text.encode().lower().decode())
    if len(held) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(held))], np.uint64) if held else np.empty(0, np.uint64)
    return np.unique(rolling(np.fromiter(map(xxhash.xxh3_64_intdigest, held), np.uint64, len(held)), SHINGLE))


def samples(items: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set."""
    least = np.full(SAMPLES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(items), 2048):
        least = np.minimum(least, (items[at : at + 2048, None] * FACTORS + SHIFTS >> np.uint64(16)).min(0))
    return least


def fold(drawn: np.ndarray) -> bytes:
    """The odd sketch: each sample flips the bit that its number and value hash to."""
    at = (mix(drawn + np.arange(SAMPLES, dtype=np.uint64), 11) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=SKETCH) & 1).tobytes()


def _sketches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n", "content", "bands", "odd"]
    for batch in batches(rows):
        n, content, bands, odd = [], [], [], []
        for text in batch.column("text").to_pylist():
            items = shingles(text)
            n.append(len(items))
            if not len(items):
                content.append(None), bands.append(None), odd.append(None)
                continue
            drawn = samples(items)
            content.append(xxhash.xxh3_128_digest(items.tobytes()))
            bands.append([xxhash.xxh3_64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(drawn.reshape(BANDS, ROWS))])
            odd.append(fold(drawn))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(content, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.binary())], names)


class Forest:
    """Disjoint sets over the places of a block, joined beforehand where their components are equal."""

    def __init__(self, component: np.ndarray) -> None:
        _, first, of = np.unique(component, return_index=True, return_inverse=True)
        self.root = first[of]

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart until now."""
        x, y = self.root[a], self.root[b]
        if x != y:
            self.root[self.root == max(x, y)] = min(x, y)
        return bool(x != y)


def _sides(members: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """A block's members once each, and which of them ask and which are asked."""
    first, second = members.part_a.iloc[0], members.part_b.iloc[0]
    members = members.drop_duplicates("id").sort_values("id").reset_index(drop=True)
    chunk = members.chunk.to_numpy()
    return members, np.flatnonzero(chunk == first), chunk == second


def _near_components(members: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest (of components) of the pairs in a block of a bucket whose sketches are near enough."""
    members, asks, asked = _sides(members)
    odd = np.frombuffer(b"".join(members.odd), np.uint64).reshape(len(members), -1)
    comp, n = members.component.to_numpy(), members.n.to_numpy()
    forest, out = Forest(comp), []
    for i in asks:
        others = np.flatnonzero(asked & (forest.root != forest.root[i]) & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])))
        near = others[np.bitwise_count(odd[others] ^ odd[i]).sum(1) <= MOST_BITS_APART]
        out += [(max(comp[i], comp[j]), min(comp[i], comp[j])) for j in near if forest.join(i, j)]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _links_across(members: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between components in a block of a cluster, found on whole sets.

    One pass over all sets of the block counts what they share with one of them.
    """
    members, asks, asked = _sides(members)
    ids, comp = members.id.to_numpy(), members.component.to_numpy()
    sizes = members["items"].map(len).to_numpy()
    flat = np.concatenate(members["items"].to_list())
    words, at = np.unique(flat, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(words), np.int64)
    forest, out = Forest(comp), []
    for i in asks:
        apart = asked & (forest.root != forest.root[i]) & (100 * np.minimum(sizes, sizes[i]) >= PERCENT * np.maximum(sizes, sizes[i]))
        if not apart.any():
            continue
        own = at[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[at], starts)
        mark[own] = 0
        linked = np.flatnonzero(apart & (100 * both >= PERCENT * (sizes + sizes[i] - both)))
        out += [(max(ids[i], ids[j]), min(ids[i], ids[j])) for j in linked if forest.join(i, j)]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _blocks(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """``rows`` in blocks of two chunks of a group, every pair of its chunks once; a small group is one chunk."""
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / most).cast("int").alias("chunks"))
    cut = rows.join(sizes, key).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return cut.withColumn("part_a", F.least("chunk", "other")).withColumn("part_b", F.greatest("chunk", "other")).drop("other", "chunks")


def _id_filter(ids: DataFrame) -> bytearray:
    """A bitmap of fixed size that has the hashed bit of every id: others may pass it too."""
    words_of = F.expr(f"shiftrightunsigned(xxhash64(id), {64 - FILTER_BITS})")
    cells = ids.select(words_of.alias("cell")).distinct()
    block = cells.groupBy(F.shiftright("cell", 13).alias("block")).agg(F.collect_list((F.col("cell") % 8192).cast("int")).alias("own"))
    bits = bytearray(1 << (FILTER_BITS - 3))

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            out = []
            for own in batch.column("own"):
                marks = np.zeros(8192, np.uint8)
                marks[own.values.to_numpy()] = 1
                out.append(np.packbits(marks).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], ["block", "bits"])

    for row in block.mapInArrow(pack, "block long, bits binary").collect():
        bits[row.block * 1024 : row.block * 1024 + 1024] = row.bits
    return bits


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, items) for the documents with an id among ``ids``, and perhaps a few others; no text is shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(bytes(_id_filter(ids)))
    needed = docs.withColumn("cell", F.expr(f"shiftrightunsigned(xxhash64(id), {64 - FILTER_BITS})"))

    def sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, np.uint8)
        for batch in batches(rows):
            cells = batch.column("cell").to_numpy()
            picked = np.flatnonzero(held[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1)
            own = batch.take(pa.array(picked))
            items = [shingles(t).view(np.int64) for t in own.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([own.column("id"), pa.array(items, pa.list_(pa.int64()))], ["id", "items"])

    return needed.where("id is not null").mapInArrow(sets, "id long, items array<long>").dropDuplicates(["id"])


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) whose whole sets are similar enough."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    found = stash(shingle_sets(docs, ids))
    a = found.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    b = found.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    return pairs.join(a, "a").join(b, "b").where(both * 100 >= (F.size("items_a") + F.size("items_b") - both) * PERCENT).select("a", "b")


def near_duplicates(documents: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    docs = documents.select(F.col(path).cast("long").alias("id"), body(text).alias("text"))
    sketched = stash(docs.mapInArrow(_sketches, "id long, n long, content binary, bands array<long>, odd binary"))
    linked = sketched.where("content is not null and id is not null")
    # one row of each class, aggregated before it is sent; an id given to several texts stands for each of them: its classes join
    whole = F.struct("n", "odd", "bands")
    classes = stash(linked.groupBy("content").agg(F.min("id").alias("leader"), F.count("*").alias("copies"), F.min_by(whole, "id").alias("own")))
    heads = classes.select(F.col("leader").alias("id"), "own.*")
    banded = heads.select("id", F.posexplode("bands").alias("band", "hash"))
    hubs = banded.groupBy("band", "hash").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high")
    met = banded.join(hubs, ["band", "hash"]).select(F.col("id").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a != b").distinct()
    own = heads.select(F.col("id").alias("a"), "n", "odd")
    of_hub = heads.select(F.col("id").alias("b"), F.col("n").alias("n_hub"), F.col("odd").alias("odd_hub"))
    stars = met.join(own, "a").join(of_hub, "b").where(f"100 * least(n, n_hub) >= {PERCENT} * greatest(n, n_hub)")
    first = stash(confirmed(docs, stash(_near(stars).select("a", "b"))))
    inside = components(first)
    placed = heads.join(inside.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = placed.select("id", "n", "odd", "component", F.posexplode("bands").alias("band", "hash"))
    mixed = placed.groupBy("band", "hash").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    open_ = placed.join(mixed.select("band", "hash"), ["band", "hash"])
    near = stash(_blocks(open_, ["band", "hash"], BLOCK).groupBy("band", "hash", "part_a", "part_b").applyInPandas(_near_components, "a long, b long").distinct())
    clusters = components(near).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    within = heads.select("id").join(inside.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")).join(clusters, "component")
    within = stash(within.join(shingle_sets(docs, within.select("id")), "id"))
    across = _blocks(within, ["cluster"], BLOCK).groupBy("cluster", "part_a", "part_b").applyInPandas(_links_across, "a long, b long")
    links = first.unionByName(across)
    roots = components(links).select(F.col("node").alias("leader"), "component")
    settled = stash(classes.select("content", "leader", "copies").join(roots, "leader", "left").select("content", "copies", F.coalesce("component", "leader").alias("component")))
    members = _with_component(sketched.select("id", "n", F.when(F.col("id").isNotNull(), F.col("content")).alias("content")), settled)
    members = members.withColumn("component_id", F.coalesce("component", "id"))
    return members.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _with_component(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the component of their content's class.

    Classes with one in ``FREQUENT`` of all rows or more, of which there can't be more than that, are broadcast; rows of
    the others meet their class in a shuffle in which no content has more rows than that, and rows without content in none.
    """
    least = F.greatest(F.lit(FEW), F.lit((classes.agg(F.sum("copies")).first()[0] or 0) // FREQUENT))
    often = classes.where(F.col("copies") >= least).select("content", F.col("component").alias("of_often"))
    marked = rows.join(F.broadcast(often), "content", "left")
    known = F.col("content").isNull() | F.col("of_often").isNotNull()
    other = marked.where(~known).drop("of_often").join(classes.where(F.col("copies") < least).select("content", "component"), "content", "left")
    return marked.where(known).withColumnRenamed("of_often", "component").unionByName(other)


def _near(pairs: DataFrame) -> DataFrame:
    """Pairs whose odd sketches (odd, odd_hub) are near enough."""

    def near(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            own, hub = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("odd", "odd_hub"))
            held = np.flatnonzero(np.bitwise_count(own ^ hub).sum(1) <= MOST_BITS_APART)
            yield batch.select(["a", "b"]).take(pa.array(held))

    return pairs.select("a", "b", "odd", "odd_hub").mapInArrow(near, "a long, b long")
