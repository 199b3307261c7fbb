"""Connected components of a link table and roots of a forest, by pointer jumping; each round is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the smallest node that it reaches."""
    both = written(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "both")
    held = labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("via"), F.col("label").alias("top"))
        step = written(step.join(up, F.col("label") == F.col("via"), "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label")), "labels")
        discard(held)
        held, labels = step, step.select("node", "label")
        if step.where("old <> label").limit(1).isEmpty():
            discard(both)
            return labels


def roots(parents: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, label) for every node of parents (a, b), each b having one row, with a the next node towards its root.

    The rounds do for paths of 2 ** rounds nodes; labels along a cycle, if there is one, are any of its nodes."""
    tops = parents.select(F.col("a").alias("node")).distinct().join(parents.select(F.col("b").alias("node")), "node", "left_anti")
    held = up = written(parents.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(tops.withColumn("label", F.col("node"))), "roots")
    for _ in range(rounds):
        over = up.select(F.col("node").alias("label"), F.col("label").alias("top"))
        step = written(up.join(over, "label").select("node", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved")), "roots")
        discard(held)
        held, up = step, step.select("node", "label")
        if step.where("moved").limit(1).isEmpty():
            break
    return up
