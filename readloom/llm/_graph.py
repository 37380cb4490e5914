"""Connected components of an edge table, by alternating large and small stars.

Each round points nodes at smaller neighbours with aggregations and equi-joins only, so a hub is
combined before the shuffle and its join is split by AQE. Rounds are written to the shared folder;
the number of rounds grows with the logarithm of the longest path. Nothing reaches the driver but
two sums that tell whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def _sum(edges: DataFrame) -> tuple:
    # a wrapping sum of hashes; decimal, because ANSI mode rejects overflow of long sums
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges``(a, b); the component is its smallest node."""
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    before = _sum(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written first: a join straight on two shuffles is one that AQE can split at a hub
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), label)
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct(), label)
        after = _sum(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
