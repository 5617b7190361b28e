"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuforge.llm import common


def components(edges: DataFrame, work: common.Workspace, what: str = "components") -> DataFrame:
    """(node, label) for every node of edges(a, b): label is the smallest node that can be reached.

    Each step sends a node's larger (or smaller) neighbours to the smallest one; the number of steps grows with the
    logarithm of the graph. Every step's edges are written, so a lost executor repeats one step. Minima are taken before
    the shuffle, and a node with very many neighbours is a skewed join key that Spark splits.
    """
    now = work.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), what)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = work.save(large, what)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = work.save(small, what)
        work.drop(large)
        work.drop(now)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()).groupBy("node").agg(F.min("label").alias("label"))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a checksum of them."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
