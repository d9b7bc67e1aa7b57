"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from framewright.session import materialize


def _smallest(neighbours: DataFrame) -> DataFrame:
    """Each node ``u`` with the smallest of itself and its neighbours ``v``."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m"))
    return least.select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(_smallest(both), "u").where("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of the links ``u``, ``v``; the root is the smallest node.

    Alternating large and small stars: each round hangs neighbours on smaller
    ones, and the number of rounds grows with the logarithm of the size. Every
    round is written to the shared folder, which cuts the lineage; a changed
    sum of hashes means that another round is needed. Nodes without a link,
    and links of a node to itself, give no row.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "links")
    before, after = None, state(now)
    while before != after:
        now = materialize(_small_star(_large_star(now)), "links")
        before, after = after, state(now)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
