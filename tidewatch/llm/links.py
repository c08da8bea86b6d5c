"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.store import drop, staged


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, root) for every node that has a link; ``root`` is the smallest node reachable.

    Each round links every node to the smallest neighbour it knows; minima are taken by aggregation, so a node with very
    many links is split over tasks.  Ends when a round changes nothing.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = staged(edges.select(high.alias("u"), low.alias("v")).where("u > v").distinct(), "links")
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("c"), "m")
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u > v").distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        met = large.join(least, F.col("u") == F.col("c"))
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(met.select("u", F.col("m").alias("v")))
        small = staged(small.where("u > v").distinct(), "links")
        changed = small.exceptAll(now).take(1) or now.exceptAll(small).take(1)
        drop(now)
        drop(large)
        now = small
        if not changed:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
