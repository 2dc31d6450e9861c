"""Connected components of an edge table, by rounds of neighbour minimum and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(id, component) for every vertex of the edges: component is the smallest id that can be reached.

    Every round takes the smallest label among a vertex and its neighbours, then the label of that label, so the number of
    rounds grows with the logarithm of a component's width for the star-shaped graphs of near-duplicates. Each round is written
    to the shared folder. Only one count per round comes to the driver. A hub with very many neighbours is summed before the
    shuffle, and the join on it is one that adaptive execution can split."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = stored(e.union(e.select("b", "a")).distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("id").alias("new"), F.col("label").alias("up"))
        jumped = stored(step.join(up, "new", "left").select("id", F.col("label").alias("old"), F.least("new", F.coalesce("up", "new")).alias("label")))
        done = jumped.where("old <> label").limit(1).count() == 0
        drop_stored(labels)
        labels = jumped
        if done:
            drop_stored(both)
            return labels.select("id", F.col("label").alias("component"))
        labels = labels.select("id", "label")
    raise RuntimeError("components did not settle")
