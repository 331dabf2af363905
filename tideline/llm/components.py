"""Connected components of a link table, by the smallest label and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b); the component is its smallest node.

    Each round takes the smallest label among neighbours and then the label of that
    label, so long chains shorten by halves. Labels are combined before the shuffle.
    Links with a null end, loops and repeated links change nothing.
    """
    known = links.where("a <> b").select("a", "b")
    edges = written(known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    labels = written(labels.select("node", F.least("node", "label").alias("label")), "labels")
    if labels.isEmpty():
        return labels.withColumnRenamed("label", "component")
    while True:
        near = (
            edges.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("label").alias("least"))
        )
        lower = written(
            labels.join(near, F.col("node") == F.col("a")).select(
                "node", F.least("label", "least").alias("label"), F.col("label").alias("before")
            ),
            "labels",
        )
        of_label = lower.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = written(
            lower.join(of_label, F.col("label") == F.col("at")).select(
                "node", F.col("further").alias("label"), "before"
            ),
            "labels",
        )
        if moved.where("label <> before").isEmpty():
            return moved.select("node", F.col("label").alias("component"))
        labels = moved.select("node", "label")
