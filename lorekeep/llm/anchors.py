"""Anchors of fixed-length windows over token sequences, and a count-min sketch of them.

Every window of W tokens contains W-g+1 grams of g tokens; the one with the
least hash (the leftmost of equals) is the window's anchor. The choice depends
on the window's content alone, so two equal windows have equal anchors at equal
offsets: a window whose anchor gram occurs once can't be repeated. Neighbouring
windows mostly share an anchor, so there are about 2/(W-g+2) anchors a token.

The sketch counts anchors, and so overestimates the count of every window. It is
dealt out by the anchors' hashes: each partition sends the cells that it touched to
the bucket which they belong to, where they are merged into a count-min sketch of
that bucket; the bucket then answers which of the anchors that were sent to it are
counted twice or more. Buckets grow in number with the input, not in size, and no
part of the sketch is broadcast, so that it stays as sparse at any size. It never
loses a repeated window. An anchor that a chunk of a partition holds twice is known
to be repeated there, and sent on once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93))
#: Cells an anchor in each row of the sketch; anchors that a bucket is meant to hold.
CELLS, BUCKET = 8, 1 << 17
#: Anchors (or tokens of a batch) held before they are worked off.
CHUNK = 1 << 19
#: Leading strings drawn at most, for the splitters of a sort.
LEADS = 100_000
#: The number of an anchor that stands for all in its chunk, which were answered there.
KNOWN = np.uint32(0xFFFFFFFF)
ENDLESS = U(0xFFFFFFFFFFFFFFFF)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64)."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n, kept for the next call."""
    held = _powers.get(int(base))
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 12)
        inverse = pow(int(base), -1, 1 << 64)
        held = tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, b, U))]) for b in (base, U(inverse)))
        _powers[int(base)] = held
    return held[0][:n], held[1][:n]


def rolling(tokens: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``length`` consecutive tokens."""
    n = len(tokens)
    if n < length:
        return np.empty(0, U)
    up, down = powers(BASES[which], n)
    sums = np.zeros(n + 1, U)
    np.cumsum(tokens * up, out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * down[: n - length + 1], which)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys, in a constant number of passes."""
    n = len(keys)
    if n < width:
        return np.empty(0, keys.dtype)
    blocks = np.full(-(-n // width) * width, ENDLESS, U)
    blocks[:n] = keys
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(tokens: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (anchor, first start, last start, gram hash).

    tokens: those of several texts on end; ends: the place after each text's last token. Windows stay in a text.
    """
    none = np.empty(0, np.int64)
    n = len(tokens)
    if n < window:
        return none, none, none, np.empty(0, U)
    hashes = rolling(tokens, gram)
    keys = (hashes & U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=U)
    anchors = (sliding_min(keys, window - gram + 1) & U(0xFFFFFFFF)).astype(np.int64)
    lengths = np.diff(ends, prepend=0)
    room = np.repeat(ends, lengths)[: n - window + 1]
    starts = np.flatnonzero(np.arange(n - window + 1) + window <= room)
    if not len(starts):
        return none, none, none, np.empty(0, U)
    of = anchors[starts]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(starts) != 1)]))
    last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
    return of[first], starts[first], starts[last], hashes[of[first]]


def grouped(texts: list[str], tokens_of: Callable[[str], np.ndarray], most: int = CHUNK) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts in groups of about ``most`` tokens: their places, their tokens on end, the ends."""
    places, parts, held = [], [], 0
    for i, text in enumerate(texts):
        parts.append(tokens_of(text))
        places.append(i)
        held += len(parts[-1])
        if held >= most:
            yield places, np.concatenate(parts), np.cumsum([len(p) for p in parts])
            places, parts, held = [], [], 0
    if places:
        yield places, np.concatenate(parts), np.cumsum([len(p) for p in parts])


def expected(df: DataFrame, a_byte: float) -> int:
    """Items, from the size of the files that are read and items a byte of them."""
    return max(1, int(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) * a_byte))


def estimates(cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The count-min estimate of each item, from its cell in each row (32 bits, cut to the sketch's width) and its weight."""
    mask = (1 << max(10, math.ceil(math.log2(CELLS * max(1, cells.shape[1]))))) - 1
    least = None
    for row in cells:
        at = (row & np.uint32(mask)).astype(np.int64)
        counts = np.bincount(np.concatenate([at, at[weights > 1]]))
        least = counts[at] if least is None else np.minimum(least, counts[at])
    return least


def repeated_anchors(rows: DataFrame, tokens_of: Callable[[str], np.ndarray], window: int, gram: int, a_byte: float, lead_of: Callable[[bytes, int], bytes] | None = None) -> DataFrame:
    """(file, row, ords, leads) of the texts (file, row, text) with anchors that may be repeated.

    ords: their numbers among the text's runs of ``anchor_runs``; leads: with ``lead_of``, leading strings of a
    bounded sample of them, as that function gives them for a text's bytes and an anchor's place.
    """
    total = expected(rows, a_byte)
    buckets = max(1, -(-total // BUCKET))
    rate = np.uint64(min(1.0, LEADS / total) * 0.999 * 2**64) if lead_of else U(0)
    record = np.dtype([("at", "<u4"), ("lead", f"V{gram}")])

    def count(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # per text: its row, and per anchor hash, number, lead or nothing
        file, base, size = None, 0, 0

        def flush() -> pa.RecordBatch:
            hashes = np.concatenate([h for _, h, _ in held])
            lengths = [len(h) for _, h, _ in held]
            delta = np.repeat(np.array([r - base for r, _, _ in held], np.uint32), lengths)
            number = np.concatenate([np.arange(n, dtype=np.uint32) for n in lengths])
            leads = {}
            at = 0
            for (_, _, drawn), n in zip(held, lengths, strict=True):
                leads.update({at + i: lead for i, lead in drawn.items()})
                at += n
            held.clear()
            order = np.argsort(hashes, kind="stable")
            sorted_ = hashes[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            counts = np.diff(np.append(first, len(order)))
            several = np.zeros(len(hashes), bool)
            several[order] = np.repeat(counts > 1, counts)
            # what the chunk holds twice is known; one of each goes on, for all of them
            known = np.flatnonzero(several)
            sent = np.concatenate([np.flatnonzero(~several), order[first[counts > 1]]])
            cells = mix(hashes[sent], 7)
            named = np.where(several[sent], KNOWN, number[sent])
            payload = np.stack([(cells & U(0xFFFFFFFF)).astype(np.uint32), (cells >> U(32)).astype(np.uint32), delta[sent], named])
            # anchors are the least of their hashes, so these are spread anew
            bucket = ((mix(hashes[sent], 13) >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            payload, bucket, source = payload[:, by], bucket[by], sent[by]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            starts = np.concatenate([[0], cuts]).astype(int)
            out = [(int(bucket[a]), payload[:, a:z].tobytes(), packed(leads, source[a:z], several)) for a, z in zip(starts, [*cuts, len(bucket)], strict=True)] if len(bucket) else []
            if len(known):
                # any bucket below zero: these need no answer
                spread = -1 - int(hashes[known[0]] % U(1 << 31))
                answered = np.stack([delta[known], number[known]]).astype(np.uint32)
                out.append((spread, answered.tobytes(), packed(leads, known, ~several)))
            places, payloads, drawn = zip(*out, strict=True) if out else ((), (), ())
            n = len(places)
            return pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([file] * n, pa.int64()), pa.array([base] * n, pa.int64()), pa.array(payloads, pa.binary()), pa.array(drawn, pa.binary())], ["bucket", "file", "base", "payload", "leads"])

        def packed(leads: dict[int, bytes], source: np.ndarray, but: np.ndarray) -> bytes:
            if not leads:
                return b""
            return np.array([(k, leads[i]) for k, i in enumerate(source.tolist()) if i in leads and not but[i]], record).tobytes()

        for batch in batches(batches_):
            files, places = batch.column("file").to_pylist(), batch.column("row").to_pylist()
            texts = batch.column("text").to_pylist()
            for group, tokens, ends in grouped(texts, tokens_of):
                anchor, lo, _, hashes = anchor_runs(tokens, ends, window, gram)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                cuts = np.searchsorted(lo, np.concatenate([starts, ends[-1:]]))
                for k, i in enumerate(group):
                    own = hashes[cuts[k] : cuts[k + 1]]
                    if not len(own):
                        continue
                    if held and (files[i] != file or size >= CHUNK or not 0 <= places[i] - base < 1 << 32):
                        yield flush()
                        size = 0
                    if not held:
                        file, base = files[i], places[i]
                    drawn = {}
                    if rate:
                        draw = np.flatnonzero(mix(own + np.array([places[i] & 0xFFFFFFFF], U) * BASES[0] + np.arange(len(own), dtype=U), 5) < rate)
                        if len(draw):
                            raw = texts[i].encode()
                            drawn = {int(d): lead_of(raw, int(anchor[cuts[k] + d] - starts[k])) for d in draw}
                    held.append((places[i], own, drawn))
                    size += len(own)
        if held:
            yield flush()

    def answer(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(file: np.ndarray, row: np.ndarray, number: np.ndarray, leads: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(file, pa.int64()), pa.array(row, pa.int64()), pa.array(number.astype(np.int32), pa.int32()), pa.array(leads, pa.binary())], ["file", "row", "ord", "lead"])

        def merged() -> Iterator[pa.RecordBatch]:
            parts = [np.frombuffer(p, np.uint32).reshape(4, -1) for _, _, p, _ in held]
            sizes = [p.shape[1] for p in parts]
            whole = np.concatenate(parts, axis=1)
            hit = (estimates(whole[:2], np.where(whole[3] == KNOWN, 2, 1)) > 1) & (whole[3] != KNOWN)
            file = np.repeat(np.array([f for f, _, _, _ in held], np.int64), sizes)
            row = np.repeat(np.array([b for _, b, _, _ in held], np.int64), sizes) + whole[2]
            yield from some(file, row, whole[3], np.flatnonzero(hit), np.cumsum([0, *sizes]), [x for _, _, _, x in held])

        def some(file: np.ndarray, row: np.ndarray, number: np.ndarray, hit: np.ndarray, offsets: np.ndarray, packs: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
            leads = {}
            for offset, pack in zip(offsets.tolist(), packs, strict=False):
                if pack.size:
                    leads.update({offset + int(x["at"]): x["lead"].tobytes() for x in np.frombuffer(pack, record)})
            for at in range(0, len(hit), 1 << 16):
                own = hit[at : at + (1 << 16)]
                yield out(file[own], row[own], number[own], [leads.get(i) for i in own.tolist()] if leads else [None] * len(own))

        at = None
        for batch in batches(batches_):
            # payloads and leads stay in the batch's buffers
            payloads, packs = ((x.as_buffer() for x in batch.column(c)) for c in ("payload", "leads"))
            for bucket, file, base, payload, pack in zip(*(batch.column(c).to_pylist() for c in ("bucket", "file", "base")), payloads, packs, strict=True):
                if bucket < 0:
                    delta, number = np.frombuffer(payload, np.uint32).reshape(2, -1)
                    yield from some(np.full(len(delta), file), base + delta.astype(np.int64), number, np.arange(len(delta)), np.zeros(1, np.int64), [pack])
                    continue
                if bucket != at and held:
                    yield from merged()
                    held.clear()
                at = bucket
                held.append((file, base, payload, pack))
        if held:
            yield from merged()

    sent = rows.select("file", "row", "text").mapInArrow(count, "bucket long, file long, base long, payload binary, leads binary")
    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, "file long, row long, ord int, lead binary")
    return found.groupBy("file", "row").agg(F.collect_list("ord").alias("ords"), F.collect_list("lead").alias("leads"))
