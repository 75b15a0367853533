"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save

#: Nodes up to which labels are broadcast; beyond, every join is by shuffle. Places for the links of one node.
FEW, SALTS = 200_000, 8


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of links(a, b): label is the smallest node that links reach.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so rounds grow with
    the logarithm of a component's diameter. Only (node, label) rows move; smallest labels are combined before a shuffle,
    so a node with many neighbours is no large group. Where labels are joined by shuffle, the rows of a node with many
    links are dealt to SALTS places, and every label goes to all of them. Null ends are dropped; an empty table gives an
    empty result.
    """
    links = links.where("a is not null and b is not null and a <> b")
    edges = save(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = save(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")), "labels")
    few = labels.count() <= FEW
    held = lambda df: F.broadcast(df) if few else df
    while True:
        there = labels.withColumnRenamed("node", "b")
        if few:
            met = edges.join(F.broadcast(there), "b")
        else:
            salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")
            met = edges.withColumn("salt", salt).join(there.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["b", "salt"])
        near = met.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        taken = near.join(held(labels), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = save(taken.join(held(jump), "label", "left").select("node", "was", F.least("label", "far").alias("label")), "labels")
        done = new.where("was <> label").isEmpty()
        discard(labels)
        labels = new.select("node", "label")
        if done:
            discard(edges)
            return labels
