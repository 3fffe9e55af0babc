"""Connected components over written tables; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of every component, by rounds of taking the smallest
    label around and jumping to the label's own label. Each round is a written table."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")))
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"))
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("least"))
        better = labels.join(around, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "least").alias("root"))
        jump = better.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = materialize(better.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")))
        labels = after.select("node", "root")
        if after.where("root <> was").isEmpty():
            return labels


def reached(edges: DataFrame) -> DataFrame:
    """node, root as components() gives them, with one shuffle a round: the labels around a node
    and its own meet in one aggregation, and the jump to the label's own label reads a written
    table, which Spark broadcasts where it is small."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")))
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"))
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "root", F.lit(None).cast(labels.schema["root"].dataType).alias("own"))
        met = around.unionByName(labels.withColumn("own", F.col("root"))).groupBy("node").agg(F.min("root").alias("root"), F.max("own").alias("was"))
        better = materialize(met)
        jump = better.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = materialize(better.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")))
        labels = after.select("node", "root")
        if after.where("root <> was").isEmpty():
            return labels


def gathered(edges: DataFrame) -> DataFrame:
    """node, root from many links (a, b) of the same nodes: each node first follows the least node
    it is linked to, one link per node, and only links that still cross go into a second run."""
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    first = reached(edges.groupBy("b").agg(F.min("a").alias("a")))
    # a node that follows none and that none follows stands for itself
    lone = edges.select(F.col("a").alias("node")).distinct().join(first, "node", "left_anti")
    near = materialize(first.select("node", "root").union(lone.select("node", F.col("node").alias("root"))))
    of_a, of_b = (near.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
    crossing = edges.join(of_a, "a").join(of_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    over = reached(crossing).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return materialize(near.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def settled(links: DataFrame) -> DataFrame:
    """node, root from rows (a, b, split): stars whose centre a is the component's root, but for
    the links of groups that were compared piece by piece (split), whose stars are put together."""
    links = materialize(links)
    done = links.where("NOT split")
    stars = done.select(F.col("b").alias("node"), F.col("a").alias("root")).union(done.select("a", F.col("a").alias("b")).distinct())
    return materialize(stars.union(components(links.where("split").select("a", "b").distinct())))
