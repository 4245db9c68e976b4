"""Connected components of a link table by alternating star steps, each a shuffle by node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.support import forget, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least node near it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _content(edges: DataFrame) -> tuple:
    """The number of distinct links and two combinations of their hashes, which tell sets of links apart."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has a link; root is the least node of the component.

    edges: a, b of an ordered type; order and repeats don't matter, links to oneself and nulls are
    passed over. An empty table gives an empty result.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, "links")
    now = _content(e)
    while True:
        after = stored(_small_star(_large_star(e)), "links")
        seen, now = now, _content(after)
        forget(e)
        e = after
        if seen == now:
            break
    # now every link goes from a node to its root
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
