"""Connected components of a link table, by alternating large and small stars.

Links stay a distributed table throughout; only two sums a round reach the
driver. Each round writes its links to the shared folder, so that the plan stays
short and a lost executor costs a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _state(links: DataFrame) -> tuple:
    """A digest of the set of links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected links (a, b); the component is its least node.

    Self-links, nulls, and links given twice or both ways count as once; no links give no rows.
    """
    links = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stash(links)
    state = _state(links)
    while state[0]:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("l")).select("l.a", "l.b")
        following = stash(small.where("a != b").distinct())
        after = _state(following)
        links = following
        if after == state:
            break
        state = after
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
