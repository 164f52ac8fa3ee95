"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlark.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (smallest node of its component) for every node of
    the undirected edges ``(a, b)``.

    Each round gives a node the smallest label around it and then the label of
    its label, so the rounds are few even where components are long chains.
    Rounds are written tables; minima are combined before they are shuffled.
    """
    both = materialize(
        edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "edges"
    )
    labels = materialize(
        both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")),
        "labels",
    )
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        lowered = labels.join(near, labels.node == near.x).select(
            "node", F.least("label", "near").alias("low"), F.col("label").alias("old")
        )
        lowered = materialize(lowered, "labels")
        target = lowered.select(F.col("node").alias("t"), F.col("low").alias("t_low"))
        jumped = lowered.join(target, lowered.low == target.t).select("node", F.least("low", "t_low").alias("label"), "old")
        jumped = materialize(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where(F.col("label") < F.col("old")).isEmpty():
            return labels
