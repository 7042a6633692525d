"""How far the word shares of sources in one language lie apart.

A group is a (lang, source) pair. Each language keeps the terms that enough of its
documents hold; a group's share of a kept term is 1 + floor(10^9 * (count + 5) / (N +
5 * V)), all in integers. Two groups' divergence is the sum of the absolute differences
of their shares over all kept terms; a group's own terms are those whose share is above
the whole language's.

Pairs are computed in tiles. The kept terms of a language are cut into chunks of about
``CHUNK``, its groups into blocks of about ``BLOCK``, both by hashes, so that no window
or sort numbers them. A group's counts in one chunk are one packed row, and each row is
sent once to every tile (block by block) that needs it; a tile reads its rows chunk by
chunk, holds two blocks of shares, and adds up its submatrix. Long vocabularies are cut
into strips of ``STRIP`` chunks whose submatrices are summed afterwards, so that a
language with few sources and many terms isn't one task.

Counts are taken by tasks first, so a source with a third of all documents sends its
terms once a task. Kept terms, group sizes and shares stay in tables; nothing is
collected or broadcast.

Cases: null text, lang and source count as ''; a group without terms, and one in a
language that keeps none, still has its pairs (0 where nothing is kept) and no terms;
repeated rows count each; ids aren't used; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, body, stash

LEAST_DOCS, TOP, WHOLE, PRIOR = 30, 50, 1_000_000_000, 5
#: Terms of a chunk and groups of a block, about; chunks of a strip; distinct terms that a task counts before it sends them on.
CHUNK, BLOCK, STRIP, HELD = 4096, 64, 16, 200_000
#: What isn't a term's byte becomes a space, A to Z lower case.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term by group; a row without a term for each group."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, of) in seen.items():
                terms = [None, *(t.decode() for t in n)]
                counts = [pa.array([0, *c], pa.int64()) for c in (n.values(), (of[t] for t in n))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.string()), *counts], ["lang", "source", "term", "n", "docs"])
            seen.clear()

        for batch in batches(rows):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, of = seen.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                own = Counter(text.encode().translate(TERM).split())
                n.update(own)
                of.update(own.keys())
                held += len(n)
                if held >= HELD:
                    yield from sent()
                    held = 0
        yield from sent()

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), body().alias("text"))
    parts = plain.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str) -> Column:
    """1 + floor(10^9 * (n + 5) / total), exact for any counts."""
    count = (F.col(n) + PRIOR).cast("decimal(27,0)") * F.lit(WHOLE).cast("decimal(10,0)")
    return F.call_function("div", count, F.col(total).cast("decimal(20,0)")) + 1


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """The same of many counts."""
    if counts.size and int(counts.max()) >= (1 << 63) // WHOLE - PRIOR:
        return np.array([1 + WHOLE * (int(c) + PRIOR) // total for c in counts.ravel()], np.int64).reshape(counts.shape)
    return 1 + WHOLE * (counts + PRIOR) // total


class Kept:
    """The tables that both parts read: each written once."""

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCS) -> None:
        counts = stash(term_counts(docs))
        by_term = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        vocabulary = stash(by_term.where(F.col("docs") >= least).select("lang", "term", "lang_n"))
        of_lang = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_sum"))
        #: (lang, source, term, n, lang_n) of kept terms that a group holds
        self.counts = stash(counts.where("term is not null").select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]))
        sums = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("own"))
        groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left")
        v = F.coalesce("v", F.lit(0).cast("long"))
        #: (lang, source, v, total, lang_total): total and lang_total are N + 5 * V of the group and its language
        self.groups = stash(groups.select("lang", "source", v.alias("v"), (F.coalesce("own", F.lit(0)) + PRIOR * v).alias("total"), (F.coalesce("lang_sum", F.lit(0)) + PRIOR * v).alias("lang_total")))
        self.vocabulary = vocabulary


def own_terms(kept: Kept, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of the terms of each group whose share is above its language's, the first ``top``."""
    rows = kept.counts.join(kept.groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    value = share("n", "total") - share("lang_n", "lang_total")
    found = rows.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def chunk_of(n: str = "chunks") -> Column:
    return F.pmod(F.xxhash64("term", F.lit(1)), F.col(n)).cast("int")


def packed(kept: Kept, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """One row for each group and chunk of its language: (lang, source, block, blocks, total, chunk, width, at, n); at numbers terms within the chunk."""
    sizes = kept.groups.groupBy("lang").agg(F.ceil(F.max("v") / chunk).cast("int").alias("chunks"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # a chunk's terms: about ``chunk`` of them are numbered together
    terms = kept.vocabulary.join(sizes.select("lang", "chunks"), "lang").select("lang", "term", chunk_of().alias("chunk"))
    terms = terms.withColumn("at", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    terms = stash(terms)
    widths = terms.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("width"))
    lists = kept.counts.join(terms, ["lang", "term"]).groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("held"))
    every = kept.groups.where("v > 0").join(sizes, "lang").select("lang", "source", "total", F.pmod(F.xxhash64("source", F.lit(2)), "blocks").cast("int").alias("block"), "blocks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    rows = every.join(widths, ["lang", "chunk"]).join(lists, ["lang", "source", "chunk"], "left")
    return rows.select("lang", "source", "block", "blocks", "total", "chunk", "width", F.coalesce(F.col("held.at"), F.array().cast("array<int>")).alias("at"), F.coalesce(F.col("held.n"), F.array().cast("array<bigint>")).alias("n"))


class Tile:
    """The pairs of two blocks of groups, over the chunks of one strip."""

    def __init__(self, lang: str, a: int, b: int) -> None:
        self.lang, self.a, self.b = lang, a, b
        self.sums: dict[str, dict[str, int]] = {}
        self.chunk: int | None = None
        self.sides: tuple[list, list] = ([], [])

    def add(self, source: str, block: int, total: int, chunk: int, width: int, at: np.ndarray, n: np.ndarray) -> None:
        if chunk != self.chunk:
            self.close()
            self.chunk = chunk
        counts = np.zeros(width, np.int64)
        counts[at] = n
        self.sides[int(block != self.a)].append((source, shares(counts, total)))

    def close(self) -> None:
        """Add the chunk's differences to the submatrix."""
        left, right = self.sides
        other = right if self.a != self.b else left
        if left and other:
            matrix = np.stack([p for _, p in other])
            for i, (source, p) in enumerate(left):
                low = 0 if self.a != self.b else i + 1
                if low < len(other):
                    row = self.sums.setdefault(source, {})
                    for (name, _), x in zip(other[low:], np.abs(matrix[low:] - p).sum(1).tolist(), strict=True):
                        row[name] = row.get(name, 0) + x
        self.sides = ([], [])

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.close()
        for source, row in self.sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(row)), pa.array([source] * len(row)), pa.array(list(row)), pa.array(list(row.values()), pa.int64())], ["lang", "a", "b", "value"])


def tiles(rows: DataFrame, strip: int = STRIP) -> DataFrame:
    """(lang, a, b, value): each pair of groups of a language once for each strip."""
    # a row of block x meets blocks 0 .. x as their right side, x .. last as their left one
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sent = rows.select(*rows.columns, other).select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), F.floor(F.col("chunk") / strip).cast("int").alias("strip"), "chunk", "source", "block", "total", "width", "at", "n")
    # rows of a chunk arrive in the order of sources, so a pair is named the same way in every chunk
    sent = sent.repartition("lang", "a", "b", "strip").sortWithinPartitions("lang", "a", "b", "strip", "chunk", "source")

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None
        for batch in batches(rows):
            keys = zip(*(batch.column(c).to_pylist() for c in ("lang", "a", "b", "strip")), strict=True)
            own = [batch.column(c).to_pylist() for c in ("source", "block", "total", "chunk", "width")]
            lists = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("at", "n")]
            for i, now in enumerate(keys):
                if now != key:
                    if tile is not None:
                        yield from tile.rows()
                    key, tile = now, Tile(*now[:3])
                tile.add(*(c[i] for c in own), *(v[o[i] : o[i + 1]] for o, v in lists))
        if tile is not None:
            yield from tile.rows()

    return sent.mapInArrow(compare, "lang string, a string, b string, value long")


def pairs(kept: Kept, chunk: int = CHUNK, block: int = BLOCK, strip: int = STRIP) -> DataFrame:
    """(lang, source, item, value, rank): every other source of each group's language by divergence."""
    sums = tiles(packed(kept, chunk, block), strip).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p")
    found = sums.select("lang", ends, "value").select("lang", "p.source", "p.item", "value")
    # languages that keep no term: every pair of groups is 0 apart
    bare = kept.groups.where("v = 0").select("lang", "source")
    zeros = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source != item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    return found.unionByName(zeros).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, chunk: int = CHUNK, block: int = BLOCK, strip: int = STRIP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    kept = Kept(docs, least)
    parts = [f.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, f in (("pair", pairs(kept, chunk, block, strip)), ("term", own_terms(kept, top)))]
    return parts[0].unionByName(parts[1])
