"""Text that nobody asked for: context packs, hints at other projects, notes on one subject, checked quotes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_markup, hint_can_name, one_line, redact, topic_keywords
from ..schema import CARD_COLLECTIONS, Config, visible

CUT = "…"
#: Notes of a project that are compared at once with as many others.
BLOCK = 2048


def context_pack(results: DataFrame, budget: int = 2000, head: str = "Relevant memories:", hints: DataFrame | None = None) -> DataFrame:
    """(query_id, lines, text) from ranked results: a line each, in order, up to the first that exceeds the budget in code points.

    A mark says that some were left out. ``hints`` (query_id, hint) stand last; their room is kept before any line takes it,
    where they fit at all.
    """
    line = F.concat(F.lit("- ["), escape_markup("project"), F.lit("] "), escape_markup(F.left(one_line(redact("document")), F.lit(600))))
    rows = results.withColumn("line", line)
    if hints is None:
        rows = rows.withColumn("hint", F.lit(None).cast("string"))
    else:
        fits = len(head) + 2 + F.char_length("hint") <= budget
        rows = rows.join(hints.select("query_id", F.when(fits, escape_markup("hint")).alias("hint")), "query_id", "left")
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.char_length("line") + 1).over(order)
    held = F.coalesce(F.char_length("hint") + 1, F.lit(0))
    rows = rows.withColumn("over", (F.lit(len(head) + 1) + held + used) > budget)
    rows = rows.withColumn("stopped", F.max("over").over(order))
    kept = F.filter(F.sort_array(F.collect_list(F.struct("rank", "line", "stopped"))), lambda r: ~r["stopped"])
    packed = rows.groupBy("query_id").agg(F.transform(kept, lambda r: r["line"]).alias("kept"), F.max("stopped").alias("cut"), F.max("hint").alias("hint"))
    none = F.array().cast("array<string>")
    mark = lambda c, x: F.when(c, F.array(x)).otherwise(none)
    body = F.array_join(F.concat(F.array(F.lit(head)), F.col("kept"), mark(F.col("cut"), F.lit(CUT)), mark(F.col("hint").isNotNull(), F.col("hint"))), "\n")
    return packed.select("query_id", F.size("kept").cast("long").alias("lines"), body.alias("text"))


def hint_lines(hints: DataFrame) -> DataFrame:
    """(query_id, hint): the hint of each query as one line, from ``scope_hint``."""
    named = F.concat("project", F.lit(" ("), F.col("hits").cast("string"), F.lit(")"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", named.alias("name")))), lambda x: x["name"])
    return hints.groupBy("query_id").agg(F.concat(F.lit("Memories on this topic in other projects: "), F.array_join(listed, ", ")).alias("hint"))


def scope_hint(inside: DataFrame, outside: DataFrame, queries: DataFrame, margin: float = 0.05, most: int = 3) -> DataFrame:
    """(query_id, place, project, hits): up to three projects outside the scope with results on topic that beat those inside.

    inside, outside: results with query_id, rank, project, score, on_topic. Without one on topic inside, any on topic outside counts.
    """
    bar = inside.where("on_topic").groupBy("query_id").agg((F.max("score") + margin).alias("bar"))
    rows = outside.where("on_topic").join(queries.select("query_id", "scope"), "query_id").join(bar, "query_id", "left")
    rows = rows.where(~F.array_contains("scope", F.col("project")) & (F.col("bar").isNull() | (F.col("score") > F.col("bar"))))
    rows = rows.where(hint_can_name("project") & ~F.col("project").isin(*CARD_COLLECTIONS))
    counted = rows.groupBy("query_id", "project").agg(F.count("*").alias("hits"), F.min("rank").alias("best"))
    order = Window.partitionBy("query_id").orderBy("best", "project")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "place", "project", "hits")


def same_subject(saved: DataFrame, memories: DataFrame, config: Config | None = None, newest: int | None = 5000, most: int = 3) -> DataFrame:
    """(saved_id, id, distance, place): saved notes of the same project on the same subject, the nearest first.

    Only the newest notes of each project are compared; with ``newest`` None all are. The notes of a project go in blocks
    of about ``BLOCK``, and each pair of blocks is one matrix product. Topic keywords are compared by their 64-bit hashes.
    """
    c = config or Config()
    rows = memories.where(visible() & (F.col("chunk_type") == "manual") & ~F.col("sensitive") & F.col("embedding").isNotNull() & F.col("project").isNotNull())
    if newest is not None:
        recent = Window.partitionBy("project").orderBy(F.desc("created_at"), F.desc("id"))
        rows = rows.withColumn("age", F.row_number().over(recent)).where(F.col("age") <= newest)
    mine = saved.where(F.col("embedding").isNotNull() & F.col("project").isNotNull())

    def blocks(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy("project").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n)).toDF("project", n)

    counts = F.broadcast(blocks(rows, "n_rows").join(blocks(mine, "n_mine"), "project"))  # a row for each project
    topics = F.transform(topic_keywords("document"), lambda t: F.xxhash64(t)).alias("topics")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shape = lambda df: df.select("project", "id", F.col("embedding").cast("array<double>").alias("embedding"), topics).join(counts, "project")
    names = ["project", "i", "j", "id", "embedding", "topics"]
    # columns of their own: both sides may stem from one table
    left = shape(mine).select("project", block("n_mine"), every("n_rows"), "id", "embedding", "topics").toDF(*names)
    right = shape(rows).select("project", every("n_mine"), block("n_rows"), "id", "embedding", "topics").toDF(*names)

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("id")  # of equal distances the lesser ids come first
        own, ids, away = a.column("id").to_pylist(), b.column("id").to_pylist(), np.abs(np.round(1.0 - _similarities(a.column("embedding").to_pylist(), b.column("embedding").to_pylist()), 6))
        mine, other = np.nonzero(away <= c.same_subject_shared)
        order = np.lexsort((other, away[mine, other], mine))
        mine, other = mine[order], other[order]
        sets: tuple[dict[int, frozenset], dict[int, frozenset]] = {}, {}
        held: tuple[list, list, list] = [], [], []
        at, taken = -1, 0
        for m, o, d in zip(mine.tolist(), other.tolist(), away[mine, other].tolist(), strict=True):
            at, taken = (at, taken) if m == at else (m, 0)
            if taken < most and own[m] != ids[o]:
                if d > c.same_subject:
                    x, y = (s[k] if k in s else s.setdefault(k, frozenset(t.column("topics")[k].as_py() or ())) for s, t, k in ((sets[0], a, m), (sets[1], b, o)))
                    least = min(len(x), len(y))
                    if (len(x & y) / least if least else 0.0) < c.shared_keywords:
                        continue
                taken += 1
                for column, value in zip(held, (own[m], ids[o], d), strict=True):
                    column.append(value)
        return pa.table({"saved_id": pa.array(held[0], pa.string()), "id": pa.array(held[1], pa.string()), "distance": pa.array(held[2], pa.float64())})

    by = ["project", "i", "j"]
    pairs = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(near, "saved_id string, id string, distance double")
    order = Window.partitionBy("saved_id").orderBy("distance", "id")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("saved_id", "id", "distance", "place")


def _similarities(a: list, b: list) -> np.ndarray:
    """Cosines of all pairs; 0 as ``cosine`` has it."""
    out = np.zeros((len(a), len(b)))
    for size in {len(v) for v in a} & {len(v) for v in b} - {0}:
        (x, u), (y, w) = (_units(v, size) for v in (a, b))
        out[np.ix_(x, y)] = u @ w.T
    return out


def _units(held: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array([i for i, v in enumerate(held) if len(v) == size and None not in v], np.int64)
    rows = np.array([held[i] for i in at], np.float64).reshape(len(at), size)
    norms = np.linalg.norm(rows, axis=1)
    ok = np.isfinite(norms) & (norms > 0)
    return at[ok], rows[ok] / norms[ok, None]


def verified_quotes(quotes: DataFrame, sources: DataFrame, most: int = 5, head: int = 1000) -> DataFrame:
    """``quotes`` (query_id, place, id, quote) that stand word for word in the first code points of their source; each source once."""
    first = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("place"))
    rows = quotes.where(F.trim("quote") != "").withColumn("nth", first).where("nth = 1").drop("nth")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("n") <= most).drop("n")
    return rows.join(sources.select("id", F.left("document", F.lit(head)).alias("head")), "id").where(F.contains("head", "quote")).drop("head")
