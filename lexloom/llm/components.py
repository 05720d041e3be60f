"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import durable


def _hang(edges: DataFrame) -> DataFrame:
    """For each ``u``: its neighbours ``v`` tied to ``m``, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hang(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hung = _hang(down)
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        hung.select("u", F.col("m").alias("v"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v); root is the least node it reaches.

    Every step is an aggregation with partial sums and an equi-join, so no node's
    neighbours are gathered in one place. Takes logarithmically many rounds; each
    round's edges are a table in the shared folder.
    """
    edges = durable(edges.where("u <> v").distinct())
    mark = None
    while True:
        stepped = _small_star(_large_star(edges)).where("u <> v").distinct()
        edges = durable(stepped)
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
