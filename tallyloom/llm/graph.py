"""Connected components of a link table, all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.sources.workspace import stage


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable, for every node in links ``a, b``.

    Each round takes the smallest label among the neighbours and then the label of that label, so a path
    of length d needs about log d rounds. Labels are written to the shared folder every round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage(both, "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        following = lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
        following = stage(following, "labels")
        labels = following.select("node", "label")
        if following.where("label <> old").isEmpty():
            return labels
