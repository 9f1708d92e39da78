"""Connected components by alternating large-star and small-star steps; DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, written


def connected_components(edges: DataFrame) -> DataFrame:
    """``v`` and ``root``, the least vertex reachable from it, for every vertex of an edge ``a``-``b``.

    Each step links vertices to the least neighbour they know; the minimum of a vertex is a partial aggregate
    and is read back as a table of its own, so a hub with a third of all edges splits like any skewed join. The
    edge table of each step is written to the shared folder. Edges of a vertex with itself and nulls are left
    out; repeated edges count once; no edges give no rows.
    """
    stars = written(edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if stars.isEmpty():
        return stars.select(F.col("u").alias("v"), F.col("v").alias("root"))
    while True:
        # Large star: every larger neighbour of a vertex goes to the least vertex the vertex knows.
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour, and the vertex itself, goes to the least smaller one.
        large = written(large)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        # Done when every vertex has one edge and no root has one.
        many = after.groupBy("u").count().filter("count > 1").select("u")
        inner = after.select("v").distinct().join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        done = many.union(inner).isEmpty()
        free(stars, first, large, least)
        stars = after
        if done:
            break
    roots = stars.select("v").distinct()
    return stars.select(F.col("u").alias("v"), F.col("v").alias("root")).union(roots.select("v", F.col("v").alias("root")))
