"""Order statistics that stay distributed when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here the rows are first
reduced to one per ``(key, value)`` and range-partitioned by ``(key, value)``; running totals are
taken inside each range and shifted by the totals of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomesh.session import durable


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: Column | str,
    sums: dict[str, str],
    descending: bool = False,
) -> DataFrame:
    """Inclusive running totals ``{new: source}`` within ``keys`` in the order of ``order``.

    ``df`` must hold one row per ``(keys, order)`` (aggregate first), so ties are not split.
    """
    by = F.col(order) if isinstance(order, str) else order
    ordering = by.desc() if descending else by.asc()
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], ordering)
    ranged = durable(ranged.withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_range")
    running = inside.orderBy(ordering).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns({new: F.sum(src).over(running) for new, src in sums.items()})
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(s).alias(f"_t_{n}") for n, s in sums.items()])
    # one row per (key, range): bounded by the number of partitions
    before = (
        Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    out = local.join(offsets, [*keys, "_range"])
    return out.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums}).drop(
        "_range", *[f"_o_{n}" for n in sums]
    )


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per distinct (keys, value) with its tie-averaged rank and count."""
    counted = running_sums(value_counts(df, keys, value), keys, value, {"upto": "cnt"})
    rank = F.col("upto") - F.col("cnt") + (F.col("cnt") + 1) / F.lit(2.0)
    return counted.select(*keys, value, "cnt", "upto", rank.alias("avg_rank"))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key, as columns named by ``probs``; NULLs skipped."""
    counted = running_sums(value_counts(df, keys, value), keys, value, {"upto": "cnt"})
    if keys:
        placed = counted.join(counted.groupBy(*keys).agg(F.sum("cnt").alias("n")), keys)
    else:
        placed = counted.withColumn("n", F.lit(counted.agg(F.sum("cnt")).first()[0]))
    start = F.col("upto") - F.col("cnt")
    parts = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo = F.floor(pos)
        hi = F.ceil(pos)
        inside = lambda k: (start <= k) & (k < F.col("upto"))
        parts += [
            F.max(F.when(inside(lo), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(inside(hi), F.col(value))).alias(f"_hi_{name}"),
            F.max(pos - lo).alias(f"_w_{name}"),
        ]
    picked = placed.groupBy(*keys).agg(*parts)
    return picked.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in probs
        ],
    )


def row_positions(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """0-based position of each row within ``keys``; ``keys + order`` must identify a row."""
    ranged = durable(
        df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_range", F.spark_partition_id())
    )
    local = ranged.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    before = (
        Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    )
    return local.join(offsets, [*keys, "_range"]).withColumn(name, F.col(name) - 1 + F.col("_o")).drop("_range", "_o")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Replace NULLs by the last non-NULL value before them within ``keys`` (the row's own included).

    Long sequences are cut into ranges: values are carried inside a range first, and each range
    then receives what the ranges before it ended with.
    """
    ranged = durable(
        df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_range", F.spark_partition_id())
    )
    inside = (
        Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.withColumns({f"_l_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns})
    position = F.struct(*order)
    ends = ranged.groupBy(*keys, "_range").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_e_{c}") for c in columns]
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_range", *[F.last(f"_e_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in columns])
    return local.join(carried, [*keys, "_range"]).select(
        *[c for c in df.columns if c not in columns], *[F.coalesce(f"_l_{c}", f"_c_{c}").alias(c) for c in columns]
    )
