"""Connected components of an edge table by randomised contraction.

In each round every node joins the node of least random rank among itself and its
neighbours, and edges are rewritten to those nodes; a fixed share of the nodes goes in each round
whatever the shape. Only sums and minima by key are shuffled; each round is
written to a table in the checkpoint folder, so that lineage stays short and a lost executor costs one round. (A checkpointed
DataFrame would keep the conditions known of its columns; over the rounds they grow until planning takes minutes.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import written


ROWS = 500_000  # edges of a task


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is some node of it, the same for all its nodes."""
    edge = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    edge = written(edge.union(edge.select("v", "u")).distinct())
    left_over = edge.count()
    tasks = left_over // ROWS + 1  # few edges need few files, whatever the number of shuffle partitions
    label = written(edge.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct().coalesce(tasks))
    turn = 0
    while left_over:
        turn += 1
        rank = lambda name: F.struct(F.xxhash64(F.col(name), F.lit(turn)).alias("rank"), F.col(name).alias("to"))  # noqa: E731, B023
        least = edge.groupBy("u").agg(F.min(rank("v")).alias("near"), F.min(rank("u")).alias("own"))
        step = written(least.select(F.col("u").alias("at"), F.least("near", "own")["to"].alias("to")).coalesce(left_over // ROWS + 1))
        joined = label.join(step, label["component"] == step["at"], "left")
        label = written(joined.select("node", F.coalesce("to", "component").alias("component")).coalesce(tasks))
        a, b = step.select(F.col("at").alias("u"), F.col("to").alias("x")), step.select(F.col("at").alias("v"), F.col("to").alias("y"))
        both = edge.join(a, "u").join(b, "v").where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()
        edge = written(both.coalesce(left_over // ROWS + 1))
        left_over = edge.count()
    return label
