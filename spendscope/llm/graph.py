"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b); a component is named by its least node.

    Each round links every node to the least neighbour below it, takes that one's own link instead where it has
    one, and moves the other edges there; chains halve, so rounds grow with the logarithm of the longest. Rounds
    read checkpoint files of the round before.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        parents = cut(edges.groupBy("u").agg(F.min("v").alias("p")))
        above = parents.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        roots = parents.join(above, "p", "left").select("u", F.coalesce("pp", "p").alias("r"), F.col("pp").isNotNull().alias("moved"))
        moved = edges.join(roots, "u").select(
            F.explode(F.array(
                F.struct("u", F.col("r").alias("v"), F.col("moved").alias("open")),
                F.struct(F.greatest("v", "r").alias("u"), F.least("v", "r").alias("v"), F.lit(True).alias("open")),
            )).alias("e")
        ).select("e.*").where("u <> v")
        edges = cut(moved.groupBy("u", "v").agg(F.max("open").alias("open")))
        if edges.where("open").isEmpty():
            break
        edges = edges.select("u", "v")
    return edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.col("v").alias("component")),
        F.struct(F.col("v").alias("node"), F.col("v").alias("component")),
    )).alias("e")).select("e.*").distinct()
