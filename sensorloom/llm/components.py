"""Connected components of a table of links, by least label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """``a, b`` (longs) to ``node, label``: the smallest node of each component.

    Every round each node takes the least label around it, then its label's label, so rounds grow
    with the logarithm of a component's width.  All state stays in tables; sums by node combine
    before they are shuffled, so a node with very many links is no hot task.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialise(both, "cc-links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        stepped = materialise(stepped, "cc-step")
        jump = stepped.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = materialise(stepped.join(jump, "label").select("node", F.col("next").alias("label"), "old"), "cc-labels")
        if labels.filter("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
