"""Connected components of a table of links, by repeated joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_dir, saved


def components(links: DataFrame, base: str) -> DataFrame:
    """(a, b) links to (node, label), label the smallest node reachable. Each round takes the least label of all
    neighbours, then that label's own label, so that long chains shorten by half; every round is written to ``base``.
    """
    spark = links.sparkSession
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{base}/both")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), f"{base}/labels-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = met.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").select("node", "old", F.least("label", "far").alias("label"))
        new = saved(jump, f"{base}/labels-{k}")
        done = not new.filter("old <> label").limit(1).count()
        drop_dir(spark, f"{base}/labels-{k - 1}")
        labels = new.select("node", "label")
        if done:
            return labels
