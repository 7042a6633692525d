"""Retrieval metrics, paired comparisons, samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources import folders
from .bm25 import CELLS, by_term, listed_terms
from .vector import Best, passes, small_batches


def first_hit(ranked: str | Column, relevant: str | Column) -> Column:
    """The place, from 1, of the first relevant entry; null without one."""
    places = F.transform(relevant, lambda r: F.array_position(ranked, r))
    return F.array_min(F.filter(places, lambda p: p > 0))


def ranking_metrics(judged: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """``judged`` (ranked, relevant) with first_rank, reciprocal_rank and, for each k, any_, all_, fraction_ and ndcg_at_k."""
    df = judged.withColumn("ranked", F.array_distinct("ranked")).withColumn("relevant", F.array_distinct("relevant"))
    df = df.withColumn("first_rank", first_hit("ranked", "relevant")).withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))
    count = F.size("relevant")
    for k in ks:
        head = F.slice("ranked", 1, k)
        hits = F.size(F.array_intersect(head, "relevant"))
        gains = F.transform(head, lambda r, i: F.when(F.array_contains("relevant", r), 1.0 / F.log2(i + 2.0)).otherwise(0.0))
        add = lambda s, x: s + x
        ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.least(count, F.lit(k)), F.lit(1))), lambda i: 1.0 / F.log2(i + 1.0)), F.lit(0.0), add)
        df = df.withColumn(f"any_{k}", (hits > 0).cast("double")).withColumn(f"all_{k}", ((hits == count) & (count > 0)).cast("double"))
        df = df.withColumn(f"fraction_{k}", F.when(count > 0, hits / count).otherwise(0.0)).withColumn(f"ndcg_{k}", F.when(count > 0, F.aggregate(gains, F.lit(0.0), add) / ideal).otherwise(0.0))
    return df


def metric_means(scored: DataFrame, category: str, metrics: list[str]) -> DataFrame:
    """Means by category and over all (category null)."""
    return scored.rollup(category).agg(F.count("*").alias("questions"), *(F.round(F.avg(m), 6).alias(m) for m in metrics))


def nearest_rank(df: DataFrame, by: list[str], column: str, shares: tuple[float, ...]) -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(share * n)."""
    name = lambda s: f"p{round(s * 100)}"
    pick = [F.expr(f"percentile_disc({s}) within group (order by {column})").alias(name(s)) for s in shares]
    return df.groupBy(*by).agg(*pick)


def throughput(runs: DataFrame) -> DataFrame:
    return runs.agg(F.try_divide(F.sum("memories").cast("double"), F.sum("seconds")).alias("per_second"))


def paired(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """One row: questions on which the first ranking is better, and the second."""
    both = a.select(key, F.col(metric).alias("x")).join(b.select(key, F.col(metric).alias("y")), key)
    return both.agg(F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") < F.col("y")).alias("losses"))


def token_overlap(queries: DataFrame, memories: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, rank, id, shared): a lexical baseline by shared distinct tokens; nothing without any.

    Each task counts what its documents share with all queries, and keeps the best of each query it has; only those meet
    in the window that ranks them. Rows of one query_id, or of one id, count as one with the tokens of all.
    """
    spark, kind = memories.sparkSession, queries.schema["query_id"].dataType
    small_batches(spark)
    asked = queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    docs = memories.select("id", F.array_distinct(tokens("document")).alias("tokens"))
    repeated = folders.kept(memories.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("again")))
    again = F.col("id").eqNullSafe(F.col("again"))
    whole = docs.join(repeated, again, "left_semi").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    docs, out = docs.join(repeated, again, "left_anti").unionByName(whole), None
    for part in passes(asked, F.char_length(F.array_join("terms", "")) + 60 * F.size("terms")):
        found = _shared(part, docs, n)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"query_id {kind.simpleString()}, rank int, id string, shared long")
    order = Window.partitionBy("query_id").orderBy(F.desc("shared"), "id")
    return out.select(F.col("query_id").cast(kind), F.row_number().over(order).alias("rank"), "id", F.col("shared").cast("long")).where(F.col("rank") <= n)


def _shared(rows: list, docs: DataFrame, n: int) -> DataFrame:
    """(query_id, id, shared, k): what each task's documents (id, distinct tokens) have that may be among the best of a query."""
    terms = sorted({t for r in rows for t in r["terms"]})
    place = {t: i for i, t in enumerate(terms)}
    held = docs.sparkSession.sparkContext.broadcast((terms, [np.array([place[t] for t in r["terms"]]) for r in rows], [None if r["query_id"] is None else str(r["query_id"]) for r in rows]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, asked, names = held.value
        known, ks = pa.array(terms, pa.string()), [n] * len(asked)
        best, bars = Best(ks, largest=True), np.ones((len(asked), 1))
        askers, first = by_term(asked, len(terms))
        for batch in batches:
            doc, term, _ = listed_terms(batch.column("tokens"), known)
            ids = np.array(batch.column("id").to_pylist(), object)
            met = np.diff(first)[term]
            sums = np.concatenate([[0], np.cumsum(met)])
            cuts = np.searchsorted(doc, np.arange(len(ids) + 1))  # of the postings, by document
            start = 0
            while start < len(ids):
                # as many documents as meet ``CELLS`` queries at most, and have as many counts; one at least
                end = int(np.searchsorted(sums[cuts], sums[cuts[start]] + CELLS, "right")) - 1
                end = min(max(end, start + 1), start + max(1, CELLS // len(asked)), len(ids))
                a, z = cuts[start], cuts[end]
                q = askers[np.repeat(first[term[a:z]] - (sums[a:z] - sums[a]), met[a:z]) + np.arange(sums[z] - sums[a])]
                counts = np.bincount(q * (end - start) + np.repeat(doc[a:z] - start, met[a:z]), minlength=len(asked) * (end - start)).reshape(len(asked), -1)
                q, at = np.nonzero(counts >= bars)
                edges = np.flatnonzero(np.diff(q, prepend=-1)).tolist()
                for i, j in zip(edges, [*edges[1:], len(q)], strict=True) if edges else ():
                    own = int(q[i])
                    best.add(own, counts[own, at[i:j]].astype(float), ids[start + at[i:j]])
                    bars[own] = -best.bars.get(own, -1.0)
                start = end
        yield from best.batches(names, ks, "shared", pa.string())

    return docs.mapInArrow(count, "query_id string, id string, shared double, k int")


def stratified_sample(questions: DataFrame, n: int, stratum: str, key: str, seed: int = 1111) -> DataFrame:
    """Exactly ``n`` rows (or all), by largest remainders of the strata's shares, drawn by a seeded hash."""
    draw = F.xxhash64(F.lit(seed), F.col(key))
    sizes = questions.groupBy(stratum).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    shares = sizes.join(F.broadcast(total), F.lit(True)).withColumn("exact", F.least(F.lit(n), F.col("total")) * F.col("size") / F.col("total"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("exact") - F.floor("exact")), stratum)  # one row for each stratum
    shares = shares.withColumn("floors", F.sum(F.floor("exact")).over(Window.partitionBy(F.lit(1)))).withColumn("place", F.row_number().over(order))
    quota = shares.select(stratum, (F.floor("exact") + (F.col("place") <= F.least(F.lit(n), F.col("total")) - F.col("floors")).cast("long")).alias("quota"))
    numbered = questions.withColumn("__n", F.row_number().over(Window.partitionBy(stratum).orderBy(draw, key)))
    return numbered.join(quota, stratum).where(F.col("__n") <= F.col("quota")).drop("__n", "quota")
