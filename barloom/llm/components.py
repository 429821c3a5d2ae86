"""Connected components by alternating large-star and small-star.

Both steps look only at a node's neighbours: large-star links every larger
neighbour to the smallest one, small-star every smaller neighbour.  Neighbour
minima are aggregated (combined before the shuffle) and joined back, so the
neighbours of a hub never meet in one task.  Each round is a written table,
which the next one replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.sinks import discard, publish


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """``e`` has v < u in every row."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def _mark(e: DataFrame) -> tuple:
    """Size and checksum of the edges."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    Loops and repeated edges are allowed, null ends are not edges; without
    edges the result is empty.
    """
    both = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull())
    e = both.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    alone = e.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    e = publish(e.where("u <> v").distinct(), "edges")
    before = _mark(e)
    while before[0]:
        # Large-star leaves every edge (larger, smaller); small-star needs them so.
        last, e = e, publish(_small_star(_large_star(e).distinct()).distinct(), "edges")
        discard(last)
        after = _mark(e)
        if after == before:
            break
        before = after
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = stars.unionByName(roots)
    return found.unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
