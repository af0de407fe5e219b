"""Connected components of an edge table, by alternating star contraction.

Every round is two DataFrame steps. *Large star*: each node links its larger
neighbours to the smallest node it sees. *Small star*: each node links its
smaller neighbours, and itself, to the smallest of them. Edges only ever move
towards smaller ids inside one component, the edge count never grows beyond
nodes plus edges, and the number of rounds is logarithmic in practice. All
state stays in tables: nothing is collected but a row count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (edges.join(low, "u").where(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)`` that has a link.

    ``u`` and ``v`` are longs without nulls, in any order, repeats and self
    links allowed; ``component`` is the smallest node reachable. Nodes without
    a link to another node are not returned. An empty table gives an empty one.
    """
    current = staged(edges.where(F.col("u") != F.col("v"))
                     .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _signature(current)
    while seen[0]:
        current = staged(_small_star(_large_star(current)), "edges")
        now = _signature(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
