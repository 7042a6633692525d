"""Threshold-scaled fingerprints, in DataFrame functions alone.

A text's fingerprint has every distinct hash of its five-word shingles that lies
below a fixed fraction of the hash range, or its least hash where none does (likely
for texts of a few words, certain for none), so that no text with words is without. It grows with the text, so that one of
a page and one of a book can be compared: the share of common hashes estimates
containment as well as likeness, and the union of two fingerprints is that of both
texts together: where that has a hash below the bound, the likeness is the share
among those of both; where it has none, it is whether their least hashes are equal.
Both estimates are unbiased, the second coarse. Words are runs of anything but space and 0x09-0x0D, lower-cased;
a text with fewer than five has its whole sequence as its one shingle.

Cases: null and empty texts, and texts of white space alone, have empty
fingerprints, and no others; two empty fingerprints have the likeness 1, an empty one and
another 0; equal texts have equal fingerprints; an empty table gives an empty result; other
columns are ignored. Documents with equal ids follow each other in an order that a hash
of them fixes, those with a null id come last.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import body, numbered

SHINGLE = 5
#: One hash in so many is retained.
ONE_IN = 4
#: Hashes are signed: those below this bound are the least quarter.
BOUND = -(1 << 63) + (1 << 64) // ONE_IN
#: Documents of an id range are put in order together: so many bytes of input files a range, within these numbers of ranges.
RANGE_BYTES, FEWEST, MOST = 2 << 20, 64, 1 << 16


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the sorted array of retained hashes of a text column: those below the bound, else the least."""
    spaced = F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     ")
    hashed = df.withColumn("__w", F.transform(F.array_remove(F.split(spaced, " "), ""), lambda w: F.xxhash64(w)))
    count = F.size("__w")
    places = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - SHINGLE, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    shingle = lambda i: F.xxhash64(*(F.get("__w", i + k) for k in range(SHINGLE)))
    every = hashed.withColumn("__h", F.sort_array(F.array_distinct(F.transform(places, shingle))))
    return every.withColumn(out, retained("__h")).drop("__w", "__h")


def below(a: str | Column) -> Column:
    """Hashes below the bound."""
    return F.filter(a, lambda h: h < F.lit(BOUND))


def retained(a: str | Column) -> Column:
    """Of sorted hashes those that a fingerprint has."""
    return F.slice(a, 1, F.greatest(F.size(below(a)), F.lit(1)))


def likeness(a: str, b: str) -> Column:
    """Estimated share of common shingles in those of either text."""
    common = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - common
    return F.when(either == 0, F.lit(1.0)).otherwise(common / either)


def containment(a: str, b: str) -> Column:
    """Estimated share of the first text's shingles that the second has; null if the first's fingerprint has no hash below the bound."""
    return F.when(F.size(below(a)) > 0, F.size(F.array_intersect(below(a), b)) / F.size(below(a)))


def merged(a: str, b: str) -> Column:
    """The fingerprint of both texts together."""
    return retained(F.sort_array(F.array_union(a, b)))


def as_text(a: str) -> Column:
    """Retained hashes as 16 hex digits each."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def at_or_below(cuts: list[int], key: Column) -> Column:
    """How many of the sorted cuts are the key or less: found among every so many first, then among those that follow."""
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    first = F.array(*(F.lit(g[0]) for g in groups))
    within = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    count = lambda a: F.size(F.filter(a, lambda c: c <= key))
    group = count(first)
    return F.when(group == 0, 0).otherwise((group - 1) * step + count(F.get(within, group - 1)))


def with_next(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Add ``next``: the columns of the row that follows by descending key and then ``order``, of the first row after the last.

    Rows are put in order by ranges of the key, not in one task; a key that fills several ranges (null too) is parted
    further by the first of ``order``, a hash. The first row of each range is sent to the range before it as well.
    Only the bounds of the ranges, a bounded number, pass through the driver.
    """
    tie = order[0]
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = max(FEWEST, min(MOST, size // RANGE_BYTES))
    shares = [i / ranges for i in range(1, ranges)]
    cuts, nulls, total = df.agg(F.percentile_approx(key, shares, 100 * ranges), F.count_if(F.col(key).isNull()), F.count("*")).first()
    parts = Counter(cuts or [])
    # a key that is a bound more than once has ranges of its own
    bounds = sorted({x for k, n in parts.items() for x in ((k, k + 1) if n > 1 and k < (1 << 63) - 1 else (k,))})
    parts = {k: n for k, n in parts.items() if n > 1}
    share = F.least(F.col(tie) / 2.0**64 + 0.5, F.lit(1 - 1e-9))
    part = F.when(F.col(key).isNull(), F.floor(share * max(1, nulls * ranges // max(1, total))))
    if parts:
        many = F.create_map(*(F.lit(x) for k, n in parts.items() for x in (k, n)))
        part = part.when(F.col(key).isin(list(parts)), F.floor(share * F.coalesce(F.get(F.array(F.element_at(many, F.col(key))), F.lit(0)), F.lit(1))))
    place = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(at_or_below(bounds, F.col(key)) if bounds else F.lit(0))
    placed = df.withColumn("__range", place.cast("int")).withColumn("__part", F.coalesce(part, F.lit(0)).cast("int"))
    head = F.max(F.struct(F.col(key), F.bitwise_not(tie).alias("least")))
    heads = placed.groupBy("__range", "__part").agg(head.alias("head")).orderBy(F.desc("__range"), "__part").collect()
    if not heads:
        return placed.withColumn("next", F.struct(*columns)).drop("__range", "__part")
    # each range's head goes to the range before, the first one's to the last
    to = [(h["head"][0], ~h["head"][1], heads[i - 1]["__range"], heads[i - 1]["__part"]) for i, h in enumerate(heads)]
    table = df.sparkSession.createDataFrame(to, "__key long, __tie long, __range int, __part int")
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col(tie) == F.col("__tie"))
    guests = df.join(F.broadcast(table), same).drop("__key", "__tie").withColumn("__guest", F.lit(True))  # as many rows as there are ranges, at most
    window = Window.partitionBy("__range", "__part").orderBy("__guest", F.desc_nulls_last(key), *order)
    both = placed.withColumn("__guest", F.lit(False)).unionByName(guests)
    return both.withColumn("next", F.lead(F.struct(*columns)).over(window)).where(~F.col("__guest")).drop("__range", "__part", "__guest")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and their likeness to each other and to the next document's.

    The edited text has the last half of the code points replaced by the first as many of the next document by descending id.
    """
    rows = numbered(docs, {"doc_id": F.col("doc_id").cast("long"), "text": body()})
    rows = rows.withColumn("tie", F.xxhash64("text", "file", "row"))
    rows = with_next(with_fingerprint(rows, "text", "own"), "doc_id", ["tie", "file", "row"], ["text", "own"])
    length = F.char_length("text")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(F.left("text", length - half), F.left("next.text", half))
    rows = with_fingerprint(rows.select("doc_id", length.cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next.own").alias("following")), "edited", "of_edited")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"),
        as_text("of_edited").alias("edited_fingerprint"),
        likeness("own", "of_edited").alias("near_edited"),
        likeness("own", "following").alias("near_next"),
    )
