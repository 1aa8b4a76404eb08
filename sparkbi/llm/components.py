"""Connected components of a link table, entirely in Spark.

Every node carries the smallest node it knows of. A round takes the smallest label among the
neighbours and then the label of that label, so distances halve. Each round is written to the
shared folder; only the number of changed labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkbi.llm.common import saved


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node in ``links`` (columns a, b: long)."""
    both = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = both.join(labels, both.a == labels.node).groupBy("b").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.node == near.b).select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        lower = saved(lower)
        target = lower.select(F.col("node").alias("at"), F.col("component").alias("beyond"))
        jumped = lower.join(target, F.col("component") == F.col("at")).select("node", "before", F.least("component", "beyond").alias("component"))
        jumped = saved(jumped)
        labels = jumped.select("node", "component")
        if jumped.where("component <> before").isEmpty():
            return labels
