"""Connected components of a links table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links``(a, b); a component is named by its smallest node.

    Every round a node takes the smallest label among its neighbours' and its
    own, then the label of that label, so paths halve. Each round's labels are
    written to the shared folder; minima are partly taken before the shuffle
    and joins on a node with very many links are ones that Spark splits.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                   .select("node", F.least("node", "m").alias("component")))
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near")))
        nearer = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("now"))
        above = labels.select(F.col("node").alias("now"), F.col("component").alias("above"))
        new = stage(nearer.join(above, "now").select("node", "old", F.least("now", "above").alias("component")))
        labels = new.select("node", "component")
        if new.filter("old <> component").isEmpty():
            return labels
