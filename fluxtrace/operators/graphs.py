"""Connected components of a graph given by its edges, by contraction.

In each round every node takes the neighbour with the smallest hash of the round, if that is smaller than its own, two
such steps are followed at once, and edges between nodes that are now one go. Hashes change from round to round, so no chain
of numbers is long in all of them: the number of nodes with edges falls by a constant factor a round on average, and
rounds grow with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roots(edges: DataFrame, settle) -> tuple[DataFrame, int]:
    """(node, root) of every node that has an edge, equal for the nodes of a component, and the number of rounds. edges: (a, b) of any
    one type, in either direction; `settle` (DataFrame -> DataFrame) cuts the lineage."""
    now = settle(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    out = settle(now.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    rounds = 0
    while not now.isEmpty():
        rounds += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(rounds), F.col(c)).alias("hash"), F.col(c).alias("node"))  # noqa: B023, E731
        best = now.groupBy("a").agg(F.min(rank("b")).alias("_best")).select("a", F.when(F.col("_best") < rank("a"), F.col("_best.node")).otherwise(F.col("a")).alias("to"))
        best = settle(best)
        again = best.select(F.col("a").alias("to"), F.col("to").alias("_next"))
        best = settle(best.join(again, "to").select("a", F.col("_next").alias("to")))
        there = best.select(F.col("a").alias("b"), F.col("to").alias("_b"))
        now = settle(now.join(best, "a").join(there, "b").where("to <> _b").select(F.col("to").alias("a"), F.col("_b").alias("b")).distinct())
        moved = best.select(F.col("a").alias("root"), F.col("to").alias("_root"))
        out = settle(out.join(moved, "root", "left").select("node", F.coalesce("_root", "root").alias("root")))
    return out, rounds
