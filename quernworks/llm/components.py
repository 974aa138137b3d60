"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import freed, written


def component_labels(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes in (a, b): label is the least node that it can reach.

    Each round takes the least label among a node's own and its neighbours', then the label's label, so
    long chains shrink fast. Labels are written out between rounds; nothing comes to the driver but
    whether any has changed. No links give no rows.
    """
    spark = links.sparkSession
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")).distinct()
    both = written(spark, both, "cc-links")
    labels = written(spark, both.groupBy("src").agg(F.least(F.min("src"), F.min("dst")).alias("label")).withColumnRenamed("src", "node"), "cc-labels")
    while True:
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.src, "left").select("node", "label", F.least("label", "near").alias("low"))
        step = written(spark, step, "cc-step")
        jump = step.select(F.col("node").alias("at"), F.col("low").alias("next"))
        jumped = step.join(jump, step.low == jump.at, "left").select("node", F.col("label").alias("old"), F.least("low", "next").alias("label"))
        jumped = written(spark, jumped, "cc-labels")
        freed(labels, step)
        labels = jumped.select("node", "label")
        labels._scratch = jumped._scratch
        if jumped.filter("label < old").isEmpty():
            freed(both)
            return labels
