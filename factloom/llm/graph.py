"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def least_neighbour(edges: DataFrame) -> DataFrame:
    """Per vertex v the least of itself and its neighbours; edges (v, u) hold both directions asked for."""
    return edges.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, component) of every vertex that has an edge: component is the least vertex reachable.

    edges has long columns a and b. Each round links every vertex's larger neighbours, then its smaller ones, to the least of them,
    until nothing changes: then each vertex hangs on its component's least. Edge counts never grow,
    a hub's neighbours are rows of a join that adaptive execution can split, and each round is cut
    into a table of the shared folder.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    now = saved(now, "edges")
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select("u", "v")).toDF("v", "u")
        large = both.join(least_neighbour(both), "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        least = least_neighbour(large)
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        now = saved(small.union(least.toDF("v", "u")).where("v <> u").distinct(), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select("v", F.col("u").alias("component")).union(now.select("u", "u").distinct())
