"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, temporary_tables


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, label`` for every vertex of ``a, b``: the label is the least vertex of its component.

    Each round takes the least label around a vertex and then that label's own least label, so distances shrink by more than half: the rounds
    grow with the logarithm of the longest path. Every round is written to the shared folder.
    """
    spark = edges.sparkSession
    with temporary_tables(spark):
        edges = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
        labels = edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("label"))
        labels = materialise(labels, "labels", keep=True)
        while True:
            around = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
            hooked = labels.join(around, labels["id"] == around["a"]).select("id", F.least("label", "near").alias("next"), "label")
            above = hooked.select(F.col("id").alias("up"), F.col("next").alias("up_next"))
            jumped = hooked.join(above, hooked["next"] == above["up"]).select("id", "label", F.least("next", "up_next").alias("next"))
            jumped = materialise(jumped, "labels", keep=True)
            done = jumped.filter("next <> label").isEmpty()
            labels = jumped.select("id", F.col("next").alias("label"))
            if done:
                return labels
