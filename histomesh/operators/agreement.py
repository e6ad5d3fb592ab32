"""Agreement between two labelings, and internal quality of a clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histomesh.functions.vectors import doubles, dot, euclid2, mean_vector


def published_pairs(assignments: DataFrame, cells: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """Cells carrying both a computed and a published label; missing published labels are dropped."""
    left = assignments.select(*on, F.col(a).alias("a"))
    right = cells.select(*on, F.col(b).alias("b")).filter(F.col("b").isNotNull())
    return left.join(right, on).select("a", "b")


def contingency(pairs: DataFrame, keys=(), a="a", b="b") -> DataFrame:
    return pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))


def crosstab(pairs: DataFrame, a="a", b="b") -> DataFrame:
    """Long contingency table with row fractions."""
    counts = contingency(pairs, (), a, b)
    return counts.withColumn("row_frac", F.col("n") / F.sum("n").over(Window.partitionBy(a)))  # one row per class


def crosstab_wide(pairs: DataFrame, columns: list, a="a", b="b", normalize: bool = True) -> DataFrame:
    """One row per ``a`` with a column per class of ``b``."""
    total = F.count(F.lit(1)) if normalize else F.lit(1)
    return pairs.groupBy(a).agg(*[(F.count_if(F.col(b) == F.lit(c)) / total).alias(f"b_{c}") for c in columns])


def best_match(pairs: DataFrame, a="a", b="b") -> DataFrame:
    """Most frequent ``b`` of every ``a`` (smallest on ties) and the share it covers."""
    table = crosstab(pairs, a, b)
    order = Window.partitionBy(a).orderBy(F.col("n").desc(), b)
    best = table.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == 1)
    return best.select(a, F.col(b).alias("best"), F.col("row_frac").alias("overlap"))


def _margins(table: DataFrame, keys, a, b):
    """Contingency table with its row, column and grand totals, all bounded by the classes."""
    return (
        table.withColumn("ra", F.sum("n").over(Window.partitionBy(*keys, a)))
        .withColumn("cb", F.sum("n").over(Window.partitionBy(*keys, b)))
        .withColumn("t", F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)]))).cast("double"))
    )


def adjusted_rand(pairs: DataFrame, keys=(), a="a", b="b") -> DataFrame:
    """Pair-counting adjusted Rand index from the contingency table."""
    keys = list(keys)
    m = _margins(contingency(pairs, keys, a, b), keys, a, b)
    choose2 = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    # a row total appears once per cell of its row: weigh it by the cell's share
    agg = m.groupBy(*keys).agg(
        F.sum(choose2("n")).alias("s"),
        F.sum(choose2("ra") * F.col("n") / F.col("ra")).alias("sa"),
        F.sum(choose2("cb") * F.col("n") / F.col("cb")).alias("sb"),
        F.max("t").alias("t"),
    )
    total = F.col("t") * (F.col("t") - 1) / 2
    expected = F.coalesce(F.try_divide(F.col("sa") * F.col("sb"), total), F.lit(0.0))
    most = (F.col("sa") + F.col("sb")) / 2
    value = F.when(F.abs(most - expected) < 1e-12, 1.0).otherwise((F.col("s") - expected) / (most - expected))
    return agg.select(*keys, value.alias("ari"))


def normalized_mutual_info(pairs: DataFrame, keys=(), a="a", b="b") -> DataFrame:
    """Mutual information over the arithmetic mean of the two entropies."""
    keys = list(keys)
    m = _margins(contingency(pairs, keys, a, b), keys, a, b)
    p, pa, pb = F.col("n") / F.col("t"), F.col("ra") / F.col("t"), F.col("cb") / F.col("t")
    agg = m.groupBy(*keys).agg(
        F.sum(p * F.log(p / (pa * pb))).alias("mi"), (-F.sum(p * F.log(pa))).alias("ha"), (-F.sum(p * F.log(pb))).alias("hb")
    )
    mean_h = (F.col("ha") + F.col("hb")) / 2
    return agg.select(*keys, F.when(mean_h < 1e-15, 1.0).otherwise(F.greatest(F.col("mi"), F.lit(0.0)) / mean_h).alias("nmi"))


def _cluster_table(points: DataFrame, vector: str, label: str):
    """Size, centroid and mean squared length of each cluster; a handful of rows."""
    return points.groupBy(label).agg(
        F.count(F.lit(1)).alias("size"), mean_vector(vector).alias("centroid"), F.avg(dot(vector, vector)).alias("sq")
    )


def silhouette_squared(points: DataFrame, vector="features", label="cn") -> DataFrame:
    """Mean silhouette with squared Euclidean distance, over all points and in one pass.

    A point's mean squared distance to a cluster follows from the cluster's size, centroid and
    mean squared length, so no pair of points is ever formed and nothing is sampled.
    """
    rows = _cluster_table(points, vector, label).orderBy(label).collect()  # one row per cluster
    if len(rows) < 2:
        raise ValueError("silhouette needs at least two clusters")
    table = F.array(
        *[
            F.struct(
                F.lit(r[label]).alias("c"), F.lit(float(r["size"])).alias("n"),
                F.lit([float(v) for v in r["centroid"]]).alias("m"), F.lit(float(r["sq"])).alias("s"),
            )
            for r in rows
        ]
    )
    mean_d = F.transform(
        table,
        lambda c: F.struct(
            (c["c"] == F.col(label)).alias("own"),
            c["n"].alias("n"),
            (dot(vector, vector) - 2 * dot(F.col(vector), c["m"]) + c["s"]).alias("d"),
        ),
    )
    scored = points.withColumn("_d", mean_d)
    own = F.filter("_d", lambda c: c["own"])[0]
    a = F.try_divide(own["d"] * own["n"], own["n"] - 1)
    b = F.array_min(F.transform(F.filter("_d", lambda c: ~c["own"]), lambda c: c["d"]))
    top = F.greatest(F.col("_a"), F.col("_b"))
    s = F.when(F.col("_n") <= 1, 0.0).when(top > 0, (F.col("_b") - F.col("_a")) / top).otherwise(0.0)
    return scored.select(own["n"].alias("_n"), a.alias("_a"), b.alias("_b")).agg(F.avg(s).alias("silhouette"))


def davies_bouldin(points: DataFrame, vector="features", label="cn") -> DataFrame:
    """Mean over clusters of the worst (scatter_i + scatter_j) / centroid distance."""
    centres = points.groupBy(label).agg(mean_vector(vector).alias("centroid"))
    scatter = (
        points.join(centres, label)
        .groupBy(label)
        .agg(F.avg(F.sqrt(euclid2(vector, "centroid"))).alias("s"))
        .join(centres, label)
    )
    table = F.array_sort(F.collect_list(F.struct(F.col(label).alias("c"), "s", "centroid")))  # clusters only
    packed = scatter.agg(table.alias("t")).withColumn("me", F.explode("t"))
    ratio = F.transform(
        F.filter("t", lambda o: o["c"] != F.col("me.c")),
        lambda o: F.try_divide(o["s"] + F.col("me.s"), F.sqrt(euclid2(o["centroid"], F.col("me.centroid")))),
    )
    return packed.agg(F.avg(F.array_max(ratio)).alias("davies_bouldin"))


def inertia(points: DataFrame, vector="features", label="cn") -> DataFrame:
    """Within-cluster sum of squares, from cluster moments."""
    t = _cluster_table(points, vector, label)
    return t.agg(F.sum(F.col("size") * (F.col("sq") - dot("centroid", "centroid"))).alias("inertia"))


def vector_of(columns: list[str]):
    return doubles(F.array(*[F.col(c).cast("double") for c in columns]))
