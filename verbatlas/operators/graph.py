"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) of all nodes with edges; the component is its smallest node.

    Each round points every node to the smallest label among its own, its neighbours' and its label's
    (pointer jumping), so rounds grow with the logarithm of the longest chain. A node with very many
    edges is no hot group: neighbours' labels are reduced to a minimum before they are shuffled. Rounds
    are written to the shared folder; null ends and self-loops are left out; no edges give no rows.
    """
    pairs = edges.select(F.col(edges.columns[0]).alias("a"), F.col(edges.columns[1]).alias("b")).where("a <> b")
    both = materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("via"))
        step = step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("via", "label")).alias("label"), (F.col("moved") | (F.coalesce("via", "label") < F.col("label"))).alias("moved"))
        step = materialise(step, "labels")
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
