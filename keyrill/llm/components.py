"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyrill.llm.shared import cut, drop


def _oriented(pairs: DataFrame) -> DataFrame:
    """u > v, each pair once."""
    return pairs.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _signature(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> node, root: the least node of each edge's component.

    Nodes without an edge to another node are absent. A round ties every
    node's larger neighbours to its least one (large star), then its smaller
    ones (small star); rounds end when no pair changes, after a number of
    rounds that grows with the logarithm of the graph. Minima are taken by
    aggregation, which combines before the shuffle, and a hub's neighbours are
    joined to one row, which Spark splits where they are many. Each round is
    written to the shared folder; only a count and a checksum reach the driver.
    """
    now = cut(_oriented(edges), "pairs")
    old = _signature(now)
    while old[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        tied = large.join(low, "u")
        small = tied.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(tied.select("u", F.col("low").alias("v")))
        after = cut(_oriented(small), "pairs")
        drop(now)
        now, new = after, _signature(after)
        if new == old:
            break
        old = new
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
