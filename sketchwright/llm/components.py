"""Connected components by alternating star contractions, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import met, written


def _with_least(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """edges (u, v) with m, the smallest neighbour of u; and (u, m, n), a row a node. The centre of a large star has many edges: it is met as a hot key."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return met(edges, least, "u", "n", total, F.xxhash64("v")), least


def components(edges: DataFrame, name: str = "components", most: int | None = None) -> DataFrame:
    """edges: (u, v). Returns (node, root) for every node of an edge, root the smallest node reachable.

    A round links every node's larger neighbours to its smallest one, then every node and its smaller
    neighbours to the smallest of these; it ends when all edges point at roots. Each round is written
    to the shared folder, so lineage stays short, in files as its edges need. Rounds grow with the logarithm
    of the component size. most: about how many edges there may be, if known.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = written(e, name, most)
    while True:
        total = 2 * e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near, _ = _with_least(both, total)
        large = written(near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), name, total)
        near, least = _with_least(large, total)
        moved = near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name, total)
        nodes = e.groupBy("u").agg(F.count("*").alias("n"))
        inner = e.select(F.col("v").alias("u")).distinct().join(e.select("u").distinct(), "u")
        if nodes.where("n > 1").isEmpty() and inner.isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
