"""Connected components of a graph of links, by the smallest node of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.support import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label is the smallest node it reaches.

    Each round, a node takes the least label around it, and then the label of that label, which
    halves long paths. Labels are written to shared storage each round; only a count returns to
    the driver. No links give no rows.
    """
    both = written(
        links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links"
    )
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        .select("node", F.least("node", "least").alias("label")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        taken = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("mid")
        )
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        moved = written(
            taken.join(jump, "mid", "left").select(
                "node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")
            ),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.filter("label <> old").isEmpty():
            return labels
