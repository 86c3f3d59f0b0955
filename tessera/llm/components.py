"""Connected components of a link table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node in links (a, b).

    Each round takes the smallest label among neighbours and then the label of that label, so that a chain of n links
    takes about log n rounds. Labels are written to the shared folder after each round; only a count of changes reaches the driver.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        nearest = labels.join(around, labels["node"] == around["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = stored(nearest.join(jump, F.col("label") == F.col("at")).select("node", F.least("label", "further").alias("label"), "old"), "labels")
        if not new.filter(F.col("label") != F.col("old")).limit(1).count():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
