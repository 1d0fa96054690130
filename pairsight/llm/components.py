"""Connected components of a distributed edge list, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(u, v) pairs of long ids -> (id, root), root the smallest id that ``id`` reaches.

    Only ids with an edge to another id appear. Null ends and self links are left out, repeated
    edges count once. Each round links every node's larger neighbours, then its smaller ones, to
    its smallest; the number of rounds grows with the logarithm of the longest path. Every round's
    edges are written to shared storage, which cuts the plan and survives lost executors. Minima
    are combined before the shuffle, so a node of very many edges is no hot group; the joins
    by node can be split by adaptive execution.
    """
    edges = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # after the first step every edge still leads from the larger to the smaller id
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        linked = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _state(new)
        discard(edges)
        edges = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_anti").select(F.col("v").alias("id"), F.col("v").alias("root"))
    )
