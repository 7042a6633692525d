"""The last step of a search: diversity among the best, or recency."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def diversify(items: DataFrame, order: list, n: str = "n") -> DataFrame:
    """At most half of the results of each query from one project, then the rest in order; ``rank`` from 1."""
    first = Window.partitionBy("query_id", "project").orderBy(*order)
    cap = F.greatest(F.floor(F.col(n) / 2), F.lit(1))
    kept = items.withColumn("deferred", F.row_number().over(first) > cap)
    last = Window.partitionBy("query_id").orderBy("deferred", *order)
    return kept.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= F.col(n)).drop("deferred")


def recent_first(items: DataFrame, n: str = "n") -> DataFrame:
    return diversify(items, [F.desc("updated_at"), "id"], n)


def _cosines(held: list) -> np.ndarray:
    """All cosines of a query's candidates; NaN where the candidate itself has no vector, 0 against one without."""
    dims = max((len(v) for v in held if v is not None), default=1)
    rows, ok = np.zeros((len(held), dims)), np.zeros(len(held), bool)
    for i, v in enumerate(held):
        if v is not None and len(v) == dims:
            rows[i], ok[i] = v, True
    norms = np.linalg.norm(rows, axis=1)
    rows[norms > 0] /= norms[norms > 0, None]
    out = rows @ rows.T
    out[~ok] = np.nan
    return out


def mmr(items: DataFrame, weight: float = 0.5, digits: int = 9) -> DataFrame:
    """``items`` (query_id, id, score, embedding, n) chosen one by one for relevance and for difference from those chosen; ``rank`` from 1.

    All columns go through the choice, so that ``items`` is computed once: give it no more than are needed.
    A candidate without a vector counts as the same as one chosen. A query has 1000 candidates at most, so its choice fits a task.
    """
    schema = StructType([*items.schema.fields, StructField("rank", IntegerType())])

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        limit = min(int(group.n.iloc[0]), len(group))
        scores = group.score.to_numpy()
        span = scores[0] - scores[-1]
        relevance = np.ones(len(scores)) if abs(span) <= np.finfo(np.float32).eps else (scores - scores[-1]) / span
        cosines = _cosines([None if v is None else np.asarray(v, np.float64) for v in group.embedding])
        chosen, nearest = [0], np.zeros(len(scores))
        left = np.ones(len(scores), bool)
        left[0] = False
        while len(chosen) < limit:
            own = cosines[:, chosen[-1]]
            nearest = np.where(np.isnan(own), 1.0, np.maximum(nearest, own))
            value = np.where(left, np.round(weight * relevance - (1 - weight) * nearest, digits), -np.inf)
            chosen.append(int(value.argmax()))  # of equals the better ranked
            left[chosen[-1]] = False
        out = group.iloc[chosen].reset_index(drop=True)
        out["rank"] = np.arange(1, len(chosen) + 1)
        return out

    return items.groupBy("query_id").applyInPandas(choose, schema)


def following_capture(results: DataFrame, memories: DataFrame, reach: int = 5) -> DataFrame:
    """``results`` with following_id: for the first result that has one, the last assistant turn of the run right after a user's turn.

    One link per search; not to a turn that the search returns itself.
    """
    from .corpus import SESSION, turns

    fits = (F.col("role") == "assistant") & ~F.col("sensitive") & (F.col("total") == 1)
    order = Window.partitionBy(*SESSION).orderBy("created_at", "id")
    after = turns(memories).withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("ahead", F.collect_list(F.struct("id", "fits")).over(order.rowsBetween(1, reach)))
    # the run of fitting turns right after: those before the first that doesn't fit
    stop = F.array_position(F.transform("ahead", lambda x: x["fits"]), False)
    run = F.when(stop == 0, F.size("ahead")).otherwise(stop.cast("int") - 1)
    linked = after.where((F.col("role") == "user") & (F.col("total") == 1)).select("id", F.when(run > 0, F.get("ahead", run - 1)["id"]).alias("following_id")).where("following_id is not null")
    mine = results.join(linked, "id", "left")
    returned = results.select("query_id", F.col("id").alias("following_id"), F.lit(True).alias("returned"))
    mine = mine.join(returned, ["query_id", "following_id"], "left").withColumn("following_id", F.when(F.col("returned").isNull(), F.col("following_id"))).drop("returned")
    first = F.min(F.when(F.col("following_id").isNotNull(), F.col("rank"))).over(Window.partitionBy("query_id"))
    return mine.withColumn("following_id", F.when(F.col("rank") == first, F.col("following_id")))
