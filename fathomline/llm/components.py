"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomline.session import cut_lineage


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a bigint, b bigint): root is the smallest node it is joined to.

    Loops and repeated edges change nothing; nodes that are their own root are
    not listed. Alternating star contraction: each round is two joins on node
    ids with minima taken before the shuffle, and rounds grow with the
    logarithm of the longest chain. Only a count and two checksums reach the
    driver.
    """
    tidy = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = cut_lineage(tidy)
    state = _state(current)
    while state[0]:
        current = cut_lineage(_small_star(_large_star(current).distinct()).distinct())
        after = _state(current)
        if after == state:
            break
        state = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
