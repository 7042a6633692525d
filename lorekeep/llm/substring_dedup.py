"""Removal of repeated word windows, with a count-min prefilter.

Words are runs of anything but space and 0x09-0x0D, compared unchanged. A window
is ``window`` consecutive words of one document; a window that starts anywhere
else too, in the same document or another, loses its words in every place. The
first pass merges partition sketches that overestimate how often each window
occurs; the second groups exactly, by a 96-bit hash of the whole window, those
alone that the sketch counts twice or more. The sketch counts a window by its anchor
(see ``anchors``), which occurs at least as often as the window does.

Cases: null texts have no words; texts shorter than a window stay whole; repeated
rows are texts of their own, and so repeat each other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words
from .repeats import Chunk, Kind, counted_windows, covered, finish, open_items, scan, window_digest

#: Words a window, words an anchor's gram.
WINDOW, GRAM = 35, 12


def word_hashes(text: str) -> np.ndarray:
    held = words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, held), np.uint64, len(held))


def _rest(text: str, ranges: np.ndarray) -> tuple[int, np.ndarray, bytes]:
    held = words(text)
    gone = covered(len(held), ranges)
    return len(held), gone, b" ".join([w for w, g in zip(held, gone.tolist(), strict=True) if not g] if len(ranges) else held)


def settle_windows(chunk: Chunk, window: int) -> tuple[dict[int, np.ndarray], list]:
    """Windows that the chunk holds twice are settled; one item goes on for all of them, and one for each other window."""
    ones, twos, docs, starts = [], [], [], []
    for i, (_, lo, hi, tokens) in enumerate(chunk.runs):
        if not len(lo):
            continue
        at = np.concatenate([np.arange(a, z + 1) for a, z in zip(lo, hi, strict=True)])
        one, two = window_digest(tokens, window)
        ones.append(one[at])
        twos.append(two[at])
        docs.append(np.full(len(at), i))
        starts.append(at)
    if not docs:
        return {}, [np.empty(0, np.int64)] * 4
    h1, h2, doc, start = map(np.concatenate, (ones, twos, docs, starts))
    order = np.lexsort((h2, h1))
    h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
    first = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
    counts = np.diff(np.append(first, len(h1)))
    several = np.repeat(counts > 1, counts)
    sent = ~several
    sent[first] = True
    ranges = {}
    gone = np.flatnonzero(several)
    gone = gone[np.argsort(doc[gone], kind="stable")]
    for own in np.split(gone, np.flatnonzero(np.diff(doc[gone])) + 1) if len(gone) else ():
        ranges[int(doc[own[0]])] = np.stack([start[own], start[own] + window], 1).ravel()
    return ranges, [doc[sent], np.where(several, -1, start)[sent], h1[sent], h2[sent]]


def word_kind(window: int = WINDOW, gram: int = GRAM) -> Kind:
    return Kind(window, gram, 0.025, word_hashes, _rest, partial(settle_windows, window=window), {"h1": "long", "h2": "int"})


def remove_repeated_windows(docs: DataFrame, path: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """Per document: path, n (words), removed, spans, kept (the words left, joined by one space; their SHA-256 with ``digest``)."""
    kind = word_kind(window, gram)
    texts, hits = scan(docs, kind, path, text)
    items = open_items(texts, hits, kind)
    # rows without an item go to groups of their own
    items = items.withColumn("h1", F.coalesce("h1", F.xxhash64("file", "row"))).withColumn("h2", F.coalesce("h2", F.lit(0)))
    return finish(texts, counted_windows(items), kind, digest)


def window_report(docs: DataFrame) -> DataFrame:
    """The digest columns of ``remove_repeated_windows``."""
    found = remove_repeated_windows(docs, digest=True)
    return found.select(F.col("path").alias("doc_id"), F.col("n").alias("n_words"), F.col("removed").alias("n_removed"), F.lower(F.hex("kept")).alias("kept_sha256"))
