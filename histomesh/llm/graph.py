"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.session import durable, release


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b: long) can reach.

    Rounds until nothing changes; in each, a node and the node its label points to take the smallest
    label among the neighbours, and labels then skip to their own labels, so that long chains close
    in about log2(length) rounds. Every round is a written table: joins have plain exchanges on
    both sides, which adaptive execution splits where one label holds most rows.
    """
    both = durable(
        edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    )
    labels = durable(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        seen = durable(labels.join(seen.withColumnRenamed("a", "node"), "node"))
        lower = seen.select("node", F.least("label", "near").alias("label"))
        hooked = seen.filter("near < label").select(F.col("label").alias("node"), F.col("near").alias("label"))
        lowered = durable(lower.unionAll(hooked).groupBy("node").agg(F.min("label").alias("label")))
        jump = lowered.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = durable(lowered.join(jump, "label").select("node", F.col("further").alias("label")))
        changed = jumped.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").limit(1).count()
        release(labels, seen, lowered)
        labels = jumped
        if not changed:
            release(both)
            return labels
