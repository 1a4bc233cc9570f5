"""Connected components of a graph whose edges fill many partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.tables import materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges (a long, b long, no nulls)``; one root per component.

    Loops and repeated edges don't matter; without edges there are no rows.

    Every round each node points to the least of its neighbours and itself, by
    a hashed order so that no chain of ids is long; the pointers are followed
    three times over, and the edges are contracted to what they point to. An
    edge list that is one large star halves like any other, as the least
    neighbour is found by partial aggregation.
    """
    edges = edges.where("a <> b").select(*(F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n")).alias(c) for c in ("a", "b")))
    edges = materialise(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    for _ in range(max_rounds):
        least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        pointers = materialise(least.select("a", "to"))
        for _ in range(2):
            further = pointers.select(F.col("a").alias("_a"), F.col("to").alias("_to"))
            pointers = pointers.join(further, pointers["to"] == further["_a"], "left").select("a", F.coalesce("_to", "to").alias("to"))
            pointers = materialise(pointers)
        labels = labels.join(pointers, labels["root"] == pointers["a"], "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = materialise(labels)
        ends = pointers.select(F.col("a").alias("_a"), F.col("to").alias("_to"))
        moved = edges.join(ends, edges["a"] == ends["_a"]).select(F.col("_to").alias("a"), "b")
        moved = moved.join(ends, moved["b"] == ends["_a"]).select("a", F.col("_to").alias("b"))
        edges = materialise(moved.where("a <> b").distinct())
        if edges.isEmpty():
            return labels.select("node.n", "root.n").toDF("node", "root")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
