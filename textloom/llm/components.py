"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge.

    Every step is a min aggregate and a join on its key, so a node with very many
    neighbours is pre-aggregated and its join can be split; the number of steps
    grows with the logarithm of the longest path.  Self loops are ignored.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    links = stash(edges.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links")
    mark = _mark(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: every neighbour above u goes to the least of u and its neighbours.
        large = both.join(least.hint("merge"), "u").filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its neighbours below it go to the least of these.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        links = stash(small, "links")
        # Equal counts and sums of hashes of pairs mean a fixed point.
        last, mark = mark, _mark(links)
        if mark == last:
            break
    own = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first())
