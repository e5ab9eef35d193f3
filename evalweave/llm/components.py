"""Connected components of a table of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.session import written


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of ``links`` (a, b): label is the smallest node it reaches.

    Each round gives a node the smallest label among its neighbours, then the label of
    that label; both are map-side combined aggregates and joins, whatever the degree.
    Rounds are written tables. An empty table gives an empty one.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    edges = written(both.distinct(), "component-edges")
    labels = written(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "component-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = lower.join(above, "label", "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label"))
        after = written(jumped, "component-labels")
        if after.where("label <> old").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
