"""What removal of repeated windows has in common, over words or over bytes.

A first scan finds, with the sketch of ``anchors``, the windows that may be repeated.
Texts then meet these findings by their place in the files, in one shuffle that is
used twice: to send the open windows on, and to end the texts when it is known which
of them are repeated. Copies that meet in one chunk of a partition are settled there
and sent on once, so that a passage which a third of all documents share reaches the
next step once a chunk. The rest is decided exactly by the operator, as ranges of
tokens to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import anchor_runs, grouped, repeated_anchors, rolling
from .common import batches, body, numbered, stash

#: Candidate windows, and characters of text, that a chunk holds at most before it is settled.
CHUNK_WINDOWS, CHUNK_CHARS = 1 << 18, 1 << 24
@dataclass
class Chunk:
    """Texts of a chunk by their places, with their open runs of windows."""

    keys: list[tuple[int, int]] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    runs: list[tuple] = field(default_factory=list)
    windows: int = 0
    chars: int = 0


def covered(n: int, ranges: np.ndarray) -> np.ndarray:
    """Marks for the tokens in [from, to) of any of the flat list of ranges."""
    if not len(ranges):
        return np.zeros(n, bool)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, ranges[0::2], 1)
    np.add.at(steps, ranges[1::2], -1)
    return np.cumsum(steps[:n]) > 0


def spans_of(gone: np.ndarray) -> int:
    """Maximal runs of marks."""
    return int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def joined_ranges(ranges: np.ndarray) -> np.ndarray:
    """The same cover by as few ranges."""
    if not len(ranges):
        return ranges
    pairs = ranges.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(pairs) - 1]])
    return np.stack([pairs[first, 0], reach[last]], axis=1).ravel()


@dataclass(frozen=True)
class Kind:
    """tokens: 64-bit token hashes of a text; rest: a text's length in tokens, and what is left of it without the marked ranges.

    settle: for a chunk, flat ranges by text for what it settles, and columns of the items that are left: the number of
    their text, ``at`` (where they start; -1 for an item that stands for two settled ones), and those named in ``items``.
    lead_of: as for ``repeated_anchors``; needs_tokens: whether ``settle`` looks at the tokens.
    """

    window: int
    gram: int
    anchors_a_byte: float
    tokens: Callable[[str], np.ndarray]
    rest: Callable[[str, np.ndarray], tuple[int, np.ndarray, bytes]]
    settle: Callable[[Chunk], tuple[dict[int, np.ndarray], list[pa.Array | np.ndarray]]]
    items: dict[str, str]
    lead_of: Callable[[bytes, int], bytes] | None = None
    needs_tokens: bool = True


def window_digest(tokens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of hash of each window, as a long and an int: among 10**13 windows, none of which is repeated, two are taken for equal with probability below 0.001."""
    return rolling(tokens, window, 1).view(np.int64), (rolling(tokens, window, 2) >> np.uint64(32)).astype(np.uint32).view(np.int32)


ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def scan(docs: DataFrame, kind: Kind, path: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The texts (file, row, path, text), and the stashed findings of the first pass."""
    texts = numbered(docs, {"path": path, "text": body(text)})
    return texts, stash(repeated_anchors(texts.select("file", "row", "text"), kind.tokens, kind.window, kind.gram, kind.anchors_a_byte, kind.lead_of))


def open_items(texts: DataFrame, hits: DataFrame, kind: Kind) -> DataFrame:
    """(file, row, ranges, at, items): a row for each open item, and one with the ranges that its chunk settles, and no item, for each text."""
    names = ["file", "row", "ranges", "at", *kind.items]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), *(ARROW[t] for t in kind.items.values())]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            ranges, (doc, *items) = kind.settle(chunk)
            keys = np.array(chunk.keys, np.int64).reshape(-1, 2)
            chunk = Chunk()
            own = [(*keys[i].tolist(), joined_ranges(r).tolist()) for i, r in ranges.items()]
            for at in range(0, len(own), 1 << 14):
                some = list(zip(*own[at : at + (1 << 14)], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(some, types, strict=False)), *(pa.nulls(len(some[0]), t) for t in types[3:])], names)
            for at in range(0, len(doc), 1 << 16):
                part = slice(at, at + (1 << 16))
                key = keys[doc[part]]
                yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.nulls(len(key), types[2]), *(pa.array(c[part], t) for c, t in zip(items, types[3:], strict=True))], names)

        for batch in batches(rows):
            files, places, texts, hits = (batch.column(c).to_pylist() for c in ("file", "row", "text", "ords"))
            for group, tokens, ends in grouped(texts, kind.tokens):
                anchor, lo, hi, _ = anchor_runs(tokens, ends, kind.window, kind.gram)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                cuts = np.searchsorted(lo, np.concatenate([starts, ends[-1:]]))
                for k, i in enumerate(group):
                    own = np.sort(np.array(hits[i], np.int64)) + cuts[k]
                    chunk.keys.append((files[i], places[i]))
                    chunk.texts.append(texts[i])
                    # a copy: a view would keep the whole group's tokens
                    held = tokens[starts[k] : ends[k]].copy() if kind.needs_tokens else None
                    chunk.runs.append((anchor[own] - starts[k], lo[own] - starts[k], hi[own] - starts[k], held))
                    chunk.windows += int((hi[own] - lo[own] + 1).sum())
                    chunk.chars += len(texts[i])
                    if chunk.windows >= CHUNK_WINDOWS or chunk.chars >= CHUNK_CHARS:
                        yield from flush()
        if chunk.keys:
            yield from flush()

    # the same columns of the texts as in ``finish``, so that their shuffle serves both
    both = texts.join(hits.select("file", "row", "ords").hint("shuffle_hash"), ["file", "row"]).select("file", "row", "path", "text", "ords")
    return both.mapInArrow(run, "file long, row long, ranges array<int>, at int, " + ", ".join(f"{k} {t}" for k, t in kind.items.items()))


def counted_windows(items: DataFrame) -> DataFrame:
    """The rows (file, row, ranges, at, h1, h2) that have ranges, or whose hash pair counts twice or more; at -1 counts as two.

    A chunk sends a window once, so a window in very many texts is a row for each of their chunks.
    """
    weight = F.when(F.col("at").isNull(), 0).when(F.col("at") < 0, 2).otherwise(1)
    total = F.sum(weight).over(Window.partitionBy("h1", "h2"))
    return items.withColumn("total", total).where("ranges is not null or total > 1 and at >= 0").select("file", "row", "ranges", "at")


def finish(texts: DataFrame, found: DataFrame, kind: Kind, digest: bool) -> DataFrame:
    """One row per text: path, n, removed, spans, kept; found: (file, row, starts of repeated windows, flat ranges)."""
    names = ["path", "n", "removed", "spans", "kept"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            ended = []
            for text, starts, more in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "more")), strict=True):
                at = np.array(starts or [], np.int64)
                ranges = np.concatenate([np.array(more or [], np.int64), np.stack([at, at + kind.window], 1).ravel()])
                n, gone, kept = kind.rest(text, ranges)
                ended.append((n, int(gone.sum()), spans_of(gone), hashlib.sha256(kept).digest() if digest else kept))
            n, removed, spans, kept = zip(*ended, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names)

    by_text = found.groupBy("file", "row").agg(F.collect_list("at").alias("starts"), F.flatten(F.collect_list("ranges")).alias("more"))
    both = texts.join(by_text.hint("shuffle_hash"), ["file", "row"], "left").select("file", "row", "path", "text", "starts", "more")
    kind_of = texts.schema["path"].dataType.simpleString()
    return both.mapInArrow(run, f"path {kind_of}, n long, removed long, spans long, kept binary")
