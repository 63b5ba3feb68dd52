"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """vertex and component, the least vertex that it reaches, of the edges' (a, b) vertices; vertices without edges and
    loops are left out.

    Each round is two grouped minima and two joins over the edges, which become stars around the components' least
    vertices; edges never multiply. The minima merge on the map side and are written, so that both sides of their join come
    straight from a shuffle and Spark can split a star's centre. Each round's edges are written to the shared folder, which
    cuts the lineage, and the tables of the round before are deleted.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # Large star: each vertex's larger neighbours go to the least of it and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # Small star: each vertex's smaller neighbours, and it itself, go to the least of them.
        lesser = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lesser, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = written(small.where("u <> v").distinct(), "edges")
        discard(now, least, large, lesser)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            stars = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
            return stars.unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError("the components didn't settle")
