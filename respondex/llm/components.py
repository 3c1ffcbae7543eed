"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondex.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that links reach, for all nodes of edges (a, b).

    Each round takes the smallest label among neighbours, then the label of the label, which
    doubles the reach. Rounds end when no label changes. All of it is minima and equi-joins:
    a hub is aggregated in the map tasks and its joins can be split; no neighbour list is
    ever built, and nothing but a count comes to the driver.
    """
    both = written(
        edges.select("a", "b")
        .union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b")
        .distinct(),
        "edges",
    )
    labels = written(
        both.groupBy(F.col("a").alias("node"))
        .agg(F.min("b").alias("b"))
        .select("node", F.least("node", "b").alias("label")),
        "labels",
    )
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        lower = (
            labels.withColumnRenamed("label", "before")
            .join(near, F.col("node") == F.col("a"))
            .select("node", "before", F.least("before", "near").alias("label"))
        )
        heads = labels.select(F.col("node").alias("head"), F.col("label").alias("head_label"))
        following = written(
            lower.join(heads, F.col("label") == F.col("head"), "left").select(
                "node", "before", F.least("label", "head_label").alias("label")
            ),
            "labels",
        )
        labels = following.select("node", "label")
        if following.where("label <> before").isEmpty():
            return labels
