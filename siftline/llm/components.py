"""Connected components of a link table, without collecting it.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): each round keeps every component connected, and after
O(log n) rounds each component is a star around its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.scratch import discard, stage

MAX_ROUNDS = 60


def _star_round(e: DataFrame) -> DataFrame:
    """e: (hi, lo) with lo < hi, no repeats."""
    both = e.select(F.col("hi").alias("n"), F.col("lo").alias("nb")).unionAll(e.select(F.col("lo").alias("n"), F.col("hi").alias("nb")))
    low = both.groupBy("n").agg(F.min("nb").alias("m")).select("n", F.least("n", "m").alias("m"))
    large = both.where("nb > n").join(low, "n").select(F.col("nb").alias("hi"), F.col("m").alias("lo"))
    least = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()


def _is_stars(e: DataFrame) -> bool:
    """True if each node is the high end of at most one link and then never a low end."""
    ends = e.select(F.col("hi").alias("n"), F.lit(1).alias("h"), F.lit(0).alias("l")).unionAll(e.select(F.col("lo").alias("n"), F.lit(0).alias("h"), F.lit(1).alias("l")))
    bad = ends.groupBy("n").agg(F.sum("h").alias("h"), F.max("l").alias("l")).where("h > 1 or (h = 1 and l = 1)")
    return bad.limit(1).isEmpty()


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node that has a link to another node.

    ``links`` may hold repeats, loops, nulls (ignored) and both directions.  ``component``
    is the smallest node reachable.  Nodes without links are not returned.  An empty link
    table gives an empty result.
    """
    e = stage(links.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if _is_stars(e):
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(e.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("component")))
        following = stage(_star_round(e), "links")
        discard(e)
        e = following
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
