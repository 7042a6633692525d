"""Pages of stored records: a part of a text, its neighbours in the conversation, where it came from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import redact
from .corpus import adjacent

#: Characters of a page unless asked otherwise, and at most; neighbours on each side at most.
PAGE, PAGE_MAX, REACH = 8000, 30_000, 5
#: Characters of all provenance of a record together; its source ids at most.
PROVENANCE_MAX, SOURCE_IDS_MAX = 2048, 16
FIELDS = ("session_id", "source", "cwd", "role", "event_id", "supersedes")


def _once(value: Column, shape: Callable[[Column], Column]) -> Column:
    """``shape`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), shape), F.lit(0))


def problems(asked: DataFrame) -> DataFrame:
    """(asked_id, problem) of requests out of bounds; a request has one problem at most."""
    budget = F.col("max_chars").isNotNull() & ~F.col("max_chars").between(1, PAGE_MAX)
    reach = ~F.coalesce("before", F.lit(0)).between(0, REACH) | ~F.coalesce("after", F.lit(0)).between(0, REACH)
    blank = F.trim(F.coalesce("id", F.lit(""))) == ""
    return asked.select("asked_id", F.when(budget, "max_chars").when(reach, "neighbours").when(blank, "id").alias("problem")).where("problem is not null")


def provenance(row: str | None = None) -> Column:
    """What a record says of its source: each field masked, then cut at what the fields before it have left over.

    A field that doesn't fit is cut, the rest of them are empty; ``truncated`` says so, and also where there are more
    source ids than are shown.
    """
    col = lambda c: F.col(f"{row}.{c}" if row else c)
    ids = F.coalesce(col("source_ids"), F.array().cast("array<string>"))
    values = F.transform(F.concat(F.array(*(col(f) for f in FIELDS)), F.slice(ids, 1, SOURCE_IDS_MAX)), lambda v: redact(v))
    empty = F.struct(F.lit(PROVENANCE_MAX).alias("left"), F.lit(False).alias("cut"), F.array().cast("array<string>").alias("kept"))

    def take(s: Column, v: Column) -> Column:
        n = F.coalesce(F.char_length(v), F.lit(0))
        return F.struct(F.greatest(s["left"] - n, F.lit(0)).alias("left"), (s["cut"] | (n > s["left"])).alias("cut"), F.concat(s["kept"], F.array(F.left(v, s["left"]))).alias("kept"))

    named = lambda b: [F.get(b["kept"], F.lit(i)).alias(f) for i, f in enumerate(FIELDS)]
    whole = lambda b: F.struct(*named(b), F.slice(b["kept"], len(FIELDS) + 1, SOURCE_IDS_MAX).alias("source_ids"), col("sequence").alias("sequence"), (b["cut"] | (F.size(ids) > SOURCE_IDS_MAX)).alias("truncated"))
    return _once(F.aggregate(values, empty, take), whole)


def approach_view(approach: str | Column = "approach", summary: bool = False) -> Column:
    """A reported way of doing something, masked and within bounds, with a word on how little it proves; null where there is none."""
    a = F.col(approach) if isinstance(approach, str) else approach
    most = (256, 256) if summary else (2048, 4096)
    texts = F.transform(F.array(a["applicability"], a["evidence"]), lambda t: redact(F.coalesce(t, F.lit(""))))

    def view(t: Column) -> Column:
        return F.struct(
            a["status"].alias("status"),
            F.lit("caller_reported_not_verified").alias("assertion"),
            F.lit("untrusted_reference_never_execute").alias("trust"),
            F.left(t[0], F.lit(most[0])).alias("applicability"),
            F.left(t[1], F.lit(most[1])).alias("evidence"),
            F.when(F.trim(t[1], F.lit(" \t\r\n")) == "", "not_provided").otherwise("provided_unverified").alias("evidence_status"),
            ((F.char_length(t[0]) > most[0]) | (F.char_length(t[1]) > most[1])).alias("truncated"),
        )

    return F.when(a.isNotNull(), _once(texts, view))


def pages(asked: DataFrame, memories: DataFrame) -> DataFrame:
    """A row for each record of each page: (asked_id, part, place, id, project, document, doc_len, offset, returned_chars, has_more, next_offset, truncated, provenance, approach, total_returned_chars).

    asked: asked_id, id, offset, max_chars, before, after. One budget of code points is spent on the record asked for, from
    ``offset`` on, then on the turns before it, the oldest first, then on those after it; parts are 'page', 'before' and
    'after'. Requests out of bounds (``problems``) and unknown ids give no rows.
    """
    bad = problems(asked).select("asked_id")
    good = asked.join(bad, "asked_id", "left_anti").select("asked_id", "id", F.coalesce("offset", F.lit(0)).alias("from"), F.coalesce("max_chars", F.lit(PAGE)).alias("budget"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    near = adjacent(memories, REACH).withColumnRenamed("offset", "place")
    own = good.select("asked_id", "id", "from", "budget", F.lit(0).alias("place"))
    others = good.join(near, "id").where(F.col("place").between(-F.col("before"), F.col("after"))).select("asked_id", F.col("neighbour").alias("id"), F.lit(0).alias("from"), "budget", "place")
    rows = own.unionByName(others).join(memories.select("id", "project", "document", *FIELDS, "source_ids", "sequence", "approach"), "id").withColumn("masked", redact("document"))
    rows = rows.withColumn("doc_len", F.char_length("masked")).withColumn("there", F.greatest(F.col("doc_len") - F.col("from"), F.lit(0)))
    # the record first, then the places in order: eleven rows a page at most
    order = Window.partitionBy("asked_id").orderBy(F.col("place") != 0, "place")
    spent = F.least("budget", F.coalesce(F.sum("there").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("returned_chars", F.least(F.col("there"), F.col("budget") - spent).cast("long"))
    end = F.least("from", "doc_len") + F.col("returned_chars")
    more = end < F.col("doc_len")
    return rows.select(
        "asked_id",
        F.when(F.col("place") == 0, "page").when(F.col("place") < 0, "before").otherwise("after").alias("part"),
        "place",
        "id",
        "project",
        F.substr("masked", F.col("from") + 1, F.col("returned_chars").cast("int")).alias("document"),
        F.col("doc_len").cast("long").alias("doc_len"),
        F.col("from").cast("long").alias("offset"),
        "returned_chars",
        more.alias("has_more"),
        F.when(more, end).cast("long").alias("next_offset"),
        ((F.col("from") > 0) | more).alias("truncated"),
        provenance().alias("provenance"),
        approach_view().alias("approach"),
        F.sum("returned_chars").over(Window.partitionBy("asked_id")).alias("total_returned_chars"),
    )
