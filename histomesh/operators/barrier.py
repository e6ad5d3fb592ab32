"""Barrier score: how often the way from immune cells to tumour leads through barrier cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.operators.spatial import knn_join
from histomesh.session import durable


def neighbour_graph(cells: DataFrame, keys: list[str], k: int, cell_id: str = "cell_id") -> DataFrame:
    """``(keys, a, b)``, both ways: cells of which one is among the other's ``k`` nearest."""
    left = cells.select(*keys, F.col(cell_id).alias("a"), "x_um", "y_um")
    right = cells.select(*keys, F.col(cell_id).alias("b"), F.col("x_um").alias("_bx"), F.col("y_um").alias("_by"))
    near = knn_join(left, right, keys, k, "a", "b", ("x_um", "y_um"), ("_bx", "_by"), exclude_self=True).select(*keys, "a", "b")
    return near.unionByName(near.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def paths_to(edges: DataFrame, cells: DataFrame, keys: list[str], target: str, barrier: str, wanted: str, cell_id: str = "cell_id", kind: str = "cell_type") -> DataFrame:
    """``(keys, cell_id, kind, hops, barriers)``: steps to the nearest cell of kind ``target``, and the fewest
    cells of kind ``barrier`` on a way of so many steps (the cell itself aside).

    A level of cells is settled per round. Edges go both ways, so a level's neighbours lie in it, in the
    level before or in the next one; only these two are kept from being reached again. Rounds end when
    nothing new is reached, or every cell of kind ``wanted`` is settled.
    """
    is_barrier = (F.col(kind) == barrier).cast("int")
    nodes = durable(cells.select(*keys, F.col(cell_id).alias("node"), F.col(kind), is_barrier.alias("_own")))
    edges = durable(edges)
    left = nodes.filter(F.col(kind) == wanted).count()
    level = durable(nodes.filter(F.col(kind) == target).select(*keys, "node", kind, F.lit(0).alias("hops"), F.lit(0).alias("_on"), F.lit(0).alias("barriers")))
    before, settled, hops = level.limit(0), [level], 0
    while left and not level.isEmpty():
        hops += 1
        reached = level.select(*keys, F.col("node").alias("a"), "_on").join(edges, [*keys, "a"]).groupBy(*keys, F.col("b").alias("node")).agg(F.min("_on").alias("barriers"))
        known = level.select(*keys, "node").unionByName(before.select(*keys, "node"))
        fresh = reached.join(known, [*keys, "node"], "left_anti").join(nodes, [*keys, "node"])
        following = fresh.select(*keys, "node", kind, F.lit(hops).alias("hops"), (F.col("barriers") + F.col("_own")).alias("_on"), "barriers")
        before, level = level, durable(following)
        settled.append(level)
        left -= level.filter(F.col(kind) == wanted).count()
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select(*keys, F.col("node").alias(cell_id), kind, "hops", "barriers")


def barrier_score(
    cells: DataFrame, immune, tumour, barrier, keys=("image_id",), k: int = 8, cell_id: str = "cell_id", kind: str = "cell_type"
) -> DataFrame:
    """``(keys, n_immune, n_adjacent, n_unreached, n_scored, n_positive, score)`` per sample.

    The graph holds the three kinds of cells. An immune cell that is no neighbour of a tumour cell and
    can reach one counts as positive if every shortest way there leads through a barrier cell; the score
    is the share of those. NULL without any.
    """
    keys = list(keys)
    own = durable(cells.filter(F.col(kind).isin(immune, tumour, barrier)).select(*keys, cell_id, kind, "x_um", "y_um"))
    paths = paths_to(neighbour_graph(own, keys, k, cell_id), own, keys, tumour, barrier, immune, cell_id, kind)
    each = own.filter(F.col(kind) == immune).select(*keys, cell_id).join(paths.drop(kind), [*keys, cell_id], "left")
    far = F.col("hops") >= 2
    out = each.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_immune"), F.count_if(F.col("hops") == 1).alias("n_adjacent"), F.count_if(F.col("hops").isNull()).alias("n_unreached"),
        F.count_if(far).alias("n_scored"), F.count_if(far & (F.col("barriers") > 0)).alias("n_positive"),
    )
    return out.withColumn("score", F.when(F.col("n_scored") > 0, F.col("n_positive") / F.col("n_scored")))
