"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, each step's edges are written to the shared
folder, and only two numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links(a, b)``; the smallest id names it.

    Null ids and links of an id with itself are ignored. No link gives no row.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    before = _state(edges)
    while True:
        edges = materialize(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node move to the least of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and itself, move to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    # The sum is taken as a decimal, since sums of hashes overflow 64 bits.
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total).first())
