"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node that can be reached) from edges ``a``, ``b``.

    Large stars and small stars in turn: each node's larger neighbours are tied to the smallest of
    them all, then the smaller ones, until nothing changes.  A round is a minimum by node, combined
    on the map side, and a join with it, in which Spark splits hubs; no list of neighbours is ever
    made.  The number of rounds grows with the logarithm of the longest path.  Edges are cut off
    their lineage each round.  Loops and nulls are ignored.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _state(now)
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are tables by themselves, so that joins are no part of their counts and Spark can split hubs.
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smaller = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(smaller, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        now = cut(small, discard=(now, least, smaller))
        state = _state(now)
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _state(edges: DataFrame):
    """Equal for equal sets of edges (and a few hash sums beyond chance)."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.sum(F.pmod(h, F.lit(1 << 40)))).first())
