"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); label is the smallest node of its component.

    A round gives every node the least label among its own and its neighbours', and then that
    label's own label, so chains shrink by doubling. The loop ends when nothing changes. Each
    table of labels is written to the shared folder; nothing but a flag comes to the driver.
    """
    edges = materialize(
        links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        .filter("u <> v")
        .distinct()
    )
    labels = edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("label"))
    labels = materialize(labels)
    while True:
        around = (
            edges.join(labels.select(F.col("node").alias("v"), "label"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lowered = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("low"))
        of_label = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        jumped = lowered.join(of_label, "low").select("node", F.least("low", "far").alias("label"), F.col("label").alias("was"))
        after = materialize(jumped)
        labels = after.select("node", "label")
        if after.filter("label <> was").isEmpty():
            return labels
