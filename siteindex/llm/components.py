"""Connected components of a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteindex.llm.common import discard, written


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least node among it and all of them."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    larger = both.where(F.col("b") > F.col("a")).join(least, "a")
    return larger.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them. Here ``a > b``."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    smaller = links.join(least, "a").where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return smaller.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links(a, b)``; the root is the component's least node.

    Large-star and small-star rounds until the links no longer change; the rounds grow with
    the logarithm of the nodes. A node with many links is met by partial minima and a join.
    """
    state = written(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    seen = None
    while True:
        mark = state.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))
        ).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        earlier, state = state, written(_small_star(_large_star(state)), "links")
        discard(earlier)
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(state.select("b", "b").distinct())
