"""Connected components of a graph given as edges, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of ``edges`` (a bigint, b bigint).

    Each round every node takes the smallest label among its neighbours' and then its label's label, until nothing changes.
    Minima are formed before rows are dealt out by node, and a join's large partitions are split at run time, so a node
    with very many neighbours doesn't hold up a task. Rounds grow with the logarithm of the longest path. Joins are merged at all sizes: a small
    one would else be broadcast in every round, and the driver holds such tables until they are collected as garbage.
    Null ends are ignored; an empty table gives no rows.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near.hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = settled(least.join(jump.hint("merge"), "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
