"""Removal of repeated byte strings with a sparse, distributed suffix array.

Texts are UTF-8 bytes. A string of ``window`` bytes that starts anywhere else too
loses its bytes in every place. The suffixes that are sorted are those at the
anchors of ``anchors``, of which every such string holds one; a sketch first drops
the anchors whose leading bytes occur once. Splitters sampled from the others'
leading ``gram`` bytes (with a hash that parts equal ones) range-partition the
anchored suffixes into buckets, each of which sorts them by multikey quicksort, eight
bytes a step. The same is done for the bytes before the anchors, backwards. Two
windows that start ``o`` bytes before their anchors are equal just if no neighbour in
the one order has a common prefix shorter than ``window - o`` between them, nor in the
other one shorter than ``o``: so each pair of orders is compared for all places at
once, on bytes.

The first and the last leading string of a bucket may go on in its neighbours, and
one that very many texts share (say, a line in a third of all documents, each time
amid other text) fills whole buckets: no bucket grows with it. These are compared
across the buckets' boundaries, in a second shuffle of their windows by 96 bits of
hash of the whole window.

Cases: null texts have no bytes; texts shorter than a window stay whole; repeated
rows repeat each other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import LEADS, mix
from .common import batches
from .repeats import Chunk, Kind, counted_windows, covered, finish, joined_ranges, open_items, scan, window_digest

#: Bytes a window, bytes by which suffixes are dealt out.
WINDOW, GRAM = 200, 100
#: Suffixes that are sorted at once, more where one leading string has more.
BLOCK = 1 << 13
#: Bytes of suffixes a bucket, and of one suffix with what is before it, about.
BUCKET_BYTES, SUFFIX_BYTES = 4 << 20, 256
BYTE_HASH = mix(np.arange(256, dtype=np.uint64), 3)


def byte_hashes(text: str) -> np.ndarray:
    return BYTE_HASH[np.frombuffer(text.encode(), np.uint8)]


def _rest(text: str, ranges: np.ndarray) -> tuple[int, np.ndarray, bytes]:
    held = text.encode()
    gone = covered(len(held), ranges)
    return len(held), gone, np.frombuffer(held, np.uint8)[~gone].tobytes() if len(ranges) else held


def lead_at(raw: bytes, at: int, gram: int) -> bytes:
    """The bytes by which a suffix is dealt out."""
    return raw[at : at + gram]


def settle_suffixes(chunk: Chunk, window: int) -> tuple[dict[int, np.ndarray], list]:
    """Equal segments that the chunk holds twice are settled; one goes on for all of them.

    seg: the bytes that a run of windows with one anchor covers; at: its place; off: the anchor's place in it.
    """
    held: dict[tuple[bytes, int], list[tuple[int, int]]] = {}
    for i, (anchor, lo, hi, _) in enumerate(chunk.runs):
        raw = chunk.texts[i].encode()
        for a, first, last in zip(anchor.tolist(), lo.tolist(), hi.tolist(), strict=True):
            held.setdefault((raw[first : last + window], a - first), []).append((i, first))
    ranges: dict[int, list[int]] = {}
    out: list[tuple] = []
    for (seg, off), places in held.items():
        i, first = places[0]
        out.append((i, -1 if len(places) > 1 else first, off, seg))
        if len(places) > 1:
            for i, first in places:
                ranges.setdefault(i, []).extend((first, first + len(seg)))
    doc, at, off, seg = zip(*out, strict=True) if out else ((), (), (), ())
    return {i: np.array(r, np.int64) for i, r in ranges.items()}, [np.array(doc, np.int64), np.array(at, np.int32), np.array(off, np.int32), seg]


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """The order of equally long byte rows: by the first eight bytes, then only within ties by the next eight, and so on."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    keys = padded.view(">u8")
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # of the row at each place: where its tie begins
    tied = np.arange(n)  # places whose rows still tie
    for step in range(keys.shape[1]):
        if not len(tied):
            break
        own = order[tied]
        key = keys[own, step].astype(np.uint64)
        by = np.lexsort((key, group[tied]))
        order[tied], key = own[by], key[by]
        bound = np.concatenate([[True], (key[1:] != key[:-1]) | (group[tied][1:] != group[tied][:-1])])
        heads = np.flatnonzero(bound)
        sizes = np.diff(np.append(heads, len(tied)))
        group[tied] = np.repeat(tied[heads], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row in order with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 1 << 14):
        some = order[at - 1 : at + (1 << 14)]
        same = rows[some[1:]] == rows[some[:-1]]
        out[at : at + len(same)] = np.where(same.all(1), rows.shape[1], same.argmin(1))
    return out


def repeated_starts(segs: list[bytes], offs: np.ndarray, twice: np.ndarray, window: int, gram: int) -> list[np.ndarray]:
    """For each segment, the places in it where repeated windows start; twice: it stands for two equal ones."""
    m, most = len(segs), window - gram
    lengths = np.fromiter(map(len, segs), np.int64, m)
    flat = np.frombuffer(b"".join(segs), np.uint8)
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]]) + offs
    right, left = np.zeros((m, window), np.uint8), np.zeros((m, max(most, 1)), np.uint8)
    after = np.minimum(lengths - offs, window)
    for rows, counts, sign, shift in ((right, after, 1, 0), (left, np.minimum(offs, most), -1, 1)):
        for cut in range(0, m, 1 << 10):
            own = counts[cut : cut + (1 << 10)]
            of = np.repeat(np.arange(cut, cut + len(own)), own)
            col = np.arange(len(of)) - np.repeat(np.cumsum(own) - own, own)
            rows[of, col] = flat[base[of] + sign * (col + shift)]
    ranks = []
    for rows in (right, left):
        order = multikey_order(rows)
        ranks.append((order, common_prefixes(rows, order)))
    # windows of a segment start from 0 to its last window start: as many bytes before the anchor
    nearest, farthest = offs - (lengths - window), offs
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    for o in range(int(max(nearest.min(), 0)), int(min(farthest.max(), most)) + 1):
        has = np.flatnonzero((nearest <= o) & (farthest >= o))
        if not len(has):
            continue
        classes = []
        for (order, lcp), need in zip(ranks, (window - o, o), strict=True):
            of = np.empty(m, np.int64)
            of[order] = np.cumsum(lcp < need)
            classes.append(of[has])
        both = classes[0] * (m + 1) + classes[1]
        _, of, counts = np.unique(both, return_inverse=True, return_counts=True)
        found = has[(counts[of] > 1) | twice[has]]
        hits.append((found.astype(np.int32), np.full(len(found), o, np.int32)))
    if not hits:
        return [np.empty(0, np.int64)] * m
    who, back = map(np.concatenate, zip(*hits, strict=True))
    by = np.argsort(who, kind="stable")
    return [offs[i] - b for i, b in enumerate(np.split(back[by], np.searchsorted(who[by], np.arange(1, m))))]


def _buckets(rows: Iterator[pa.RecordBatch], window: int, gram: int, block: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their leading bytes: ranges, or the windows of the first and the last leading string."""
    names = ["file", "row", "ranges", "at", "h1", "h2"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int32()]
    held: list[tuple] = []  # leading strings that are whole
    last: list[tuple] = []  # the one that may go on
    lead, leads = None, 0

    def ranges_of(some: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*some, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=False)), *(pa.nulls(len(some), t) for t in types[3:])], names)

    def sort(some: list[tuple]) -> Iterator[pa.RecordBatch]:
        # a leading string with one segment that stands for itself has no second window
        alone: dict[bytes, int] = {}
        for x in some:
            alone[x[5]] = alone.get(x[5], 0) + 1 + (x[2] < 0)
        some = [x for x in some if alone[x[5]] > 1]
        if not some:
            return
        files, places, ats, offs, segs, _ = zip(*some, strict=True)
        at, out = np.array(ats, np.int64), []
        for file, row, place, starts in zip(files, places, ats, repeated_starts(list(segs), np.array(offs, np.int64), at < 0, window, gram), strict=True):
            if place >= 0 and len(starts):
                out.append((file, row, joined_ranges(np.stack([starts + place, starts + place + window], 1).ravel()).tolist()))
        if out:
            yield ranges_of(out)

    def across(some: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Every window, to be compared with those of other buckets."""
        for cut in range(0, len(some), 1 << 10):
            parts: list[list[np.ndarray]] = [[] for _ in range(5)]
            for file, row, at, _, seg, _ in some[cut : cut + (1 << 10)]:
                ones, twos = window_digest(BYTE_HASH[np.frombuffer(seg, np.uint8)], window)
                n = len(ones)
                places = np.full(n, -1) if at < 0 else at + np.arange(n)
                for part, own in zip(parts, (np.full(n, file), np.full(n, row), places, ones, twos), strict=True):
                    part.append(own)
            file, row, *own = map(np.concatenate, parts)
            yield pa.RecordBatch.from_arrays([pa.array(file, types[0]), pa.array(row, types[1]), pa.nulls(len(file), types[2]), *(pa.array(c, t) for c, t in zip(own, types[3:], strict=True))], names)

    for batch in batches(rows):
        settled = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("file", "row", "at", "off", "seg", "ranges")), strict=True):
            *own, seg, ranges = row
            if ranges is not None:
                settled.append((own[0], own[1], ranges))
                continue
            key = lead_at(seg, own[3], gram)
            if key != lead:
                if leads == 1:
                    yield from across(last)
                else:
                    held += last
                    if len(held) >= block:
                        yield from sort(held)
                        held = []
                lead, leads, last = key, leads + 1, []
            last.append((*own, seg, key))
            if leads == 1 and len(last) >= 1 << 12:
                yield from across(last)
                last = []
        if settled:
            yield ranges_of(settled)
    yield from sort(held)
    yield from across(last)


def byte_kind(window: int = WINDOW, gram: int = GRAM) -> Kind:
    return Kind(window, gram, 0.04, byte_hashes, _rest, partial(settle_suffixes, window=window), {"off": "int", "seg": "binary"}, partial(lead_at, gram=gram), needs_tokens=False)


def splitters(hits: DataFrame, buckets: int) -> list[tuple[bytes, int]]:
    """Bounds between buckets: leading strings, each with a hash that parts those equal to it, from the bounded sample of ``hits``."""
    drawn = hits.select("file", "row", F.posexplode("leads").alias("k", "lead")).select("lead", F.xxhash64("file", "row", "k").alias("tie"))
    sample = sorted((bytes(r["lead"]), r["tie"]) for r in drawn.orderBy(F.xxhash64("tie"), "tie").limit(LEADS).collect())
    return sorted({sample[i * len(sample) // buckets] for i in range(1, buckets)}) if sample else []


def remove_repeated_bytes(docs: DataFrame, path: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, digest: bool = False, block: int = BLOCK) -> DataFrame:
    """Per document: path, n (bytes), removed, spans (maximal removed runs), kept (the bytes left; their SHA-256 with ``digest``)."""
    kind = byte_kind(window, gram)
    texts, hits = scan(docs, kind, path, text)
    anchors = hits.agg(F.sum(F.size("ords"))).first()[0] or 0
    bounds = docs.sparkSession.sparkContext.broadcast(splitters(hits, max(1, -(-anchors * SUFFIX_BYTES // BUCKET_BYTES), session_partitions(docs))))

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each suffix's bucket; rows without one go to any."""
        for batch in batches(rows):
            own = []
            for file, row, at, off, seg in zip(*(batch.column(c).to_pylist() for c in ("file", "row", "at", "off", "seg")), strict=True):
                tie = xxhash.xxh3_64_intdigest(b"%d %d %d %d" % (file, row, -2 if at is None else at, off or 0)) - (1 << 63)
                own.append(tie % (len(bounds.value) + 1) if seg is None else bisect_right(bounds.value, (lead_at(seg, off, gram), tie)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], [*batch.schema.names, "bucket"])

    items = open_items(texts, hits, kind)
    dealt = items.mapInArrow(deal, items.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", bucket int")
    lead = F.substring("seg", F.col("off") + 1, F.lit(gram))  # ordered by, but not sent along
    dealt = dealt.repartitionById(len(bounds.value) + 1, "bucket").sortWithinPartitions(lead)
    ranges = dealt.mapInArrow(lambda r: _buckets(r, window, gram, block), "file long, row long, ranges array<int>, at int, h1 long, h2 int")
    ranges = ranges.withColumn("h1", F.coalesce("h1", F.xxhash64("file", "row"))).withColumn("h2", F.coalesce("h2", F.lit(0)))
    return finish(texts, counted_windows(ranges), kind, digest)


def session_partitions(df: DataFrame) -> int:
    """Partitions of a shuffle in this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def byte_report(docs: DataFrame) -> DataFrame:
    """The digest columns of ``remove_repeated_bytes``."""
    found = remove_repeated_bytes(docs, digest=True)
    return found.select(F.col("path").alias("doc_id"), F.col("n").alias("n_bytes"), F.col("removed").alias("n_removed"), F.col("spans").alias("n_spans"), F.lower(F.hex("kept")).alias("kept_sha256"))
