"""Coefficient of variation of a Gaussian kernel density, evaluated at the points themselves.

The bandwidth is the sample covariance shrunk by n^(-1/6) per axis. Points are whitened so that
the kernel is exp(-distance^2 / 2). Groups up to ``direct_max`` points are summed pair by pair.
Larger groups would need n^2 pairs in one group, so they use a grid of unit boxes: each box keeps
a fixed-size table of moments, boxes within 9 bandwidths exchange them, and each point evaluates
one polynomial. That is linear in the points and agrees with the pair sum to about 1e-10.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.operators.groups import by_whole_groups, column

TERMS = 18  # polynomial terms per axis
REACH = 9  # boxes; the kernel is below 1e-13 beyond


def whitened(points: DataFrame, group: list[str]) -> DataFrame:
    """``u, v`` in bandwidth units plus the group size; degenerate groups drop out."""
    stats = points.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.var_samp("x_um").alias("sxx"), F.var_samp("y_um").alias("syy"), F.covar_samp("x_um", "y_um").alias("sxy"),
        F.avg("x_um").alias("mx"), F.avg("y_um").alias("my"),
    )
    shrink = F.pow(F.col("n").cast("double"), F.lit(-1.0 / 6.0))
    schur = F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    factors = stats.filter((F.col("n") > 2) & (F.col("sxx") > 0) & (schur > F.col("syy") * 1e-12)).select(
        *group, "n", "mx", "my",
        (F.sqrt("sxx") * shrink).alias("l11"),
        (F.col("sxy") / F.sqrt("sxx") * shrink).alias("l21"),
        (F.sqrt(schur) * shrink).alias("l22"),
    )
    u = (F.col("x_um") - F.col("mx")) / F.col("l11")
    v = (F.col("y_um") - F.col("my") - F.col("l21") * u) / F.col("l22")
    return points.select(*group, "x_um", "y_um").join(factors, group).select(*group, "n", u.alias("u"), v.alias("v"))


def _summary(sums: DataFrame, group: list[str]) -> DataFrame:
    """Weighted mean and population sd of the density sums."""
    return sums.groupBy(*group).agg((F.stddev_pop("s") / F.avg("s")).alias("kde_summary"))


def _pair_sums(points: DataFrame, group: list[str]) -> DataFrame:
    """``s`` of every point, all pairs of a group met in the task that has it."""

    def sums(table: pa.Table, starts: np.ndarray) -> pa.Table | None:
        u, v = column(table, "u"), column(table, "v")
        known, s = np.isfinite(u) & np.isfinite(v), np.zeros(len(u))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            at = a + np.flatnonzero(known[a:b])
            du, dv = u[at, None] - u[at], v[at, None] - v[at]
            s[at] = np.exp(-(du * du + dv * dv) / 2).sum(1)
        at = pa.array(np.flatnonzero(known))
        return pa.Table.from_arrays([*(table.column(k).take(at).combine_chunks() for k in group), pa.array(s[known])], [*group, "s"])

    kinds = dict(points.dtypes)
    return by_whole_groups(points.select(*group, "u", "v"), group, [], sums, ", ".join(f"`{k}` {kinds[k]}" for k in group) + ", s double")


def _hermite(x: np.ndarray, count: int) -> np.ndarray:
    """He_n(x) exp(-x^2/2) for n < count, along the last axis."""
    out = np.empty(x.shape + (count,))
    out[..., 0] = np.exp(-x * x / 2)
    out[..., 1] = x * out[..., 0]
    for n in range(2, count):
        out[..., n] = x * out[..., n - 1] - (n - 1) * out[..., n - 2]
    return out


def _moments(group: list[str]):
    scale = np.array([1.0 / math.factorial(a) for a in range(TERMS)])

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            du = (pdf["u"] - pdf["bu"] - 0.5).to_numpy()
            dv = (pdf["v"] - pdf["bv"] - 0.5).to_numpy()
            pu = du[:, None] ** np.arange(TERMS) * scale
            pv = dv[:, None] ** np.arange(TERMS) * scale
            box = pdf.groupby([*group, "bu", "bv"], sort=False)
            rows = []
            for key, where in box.indices.items():
                rows.append([*key, (pu[where].T @ pv[where]).ravel()])
            yield pd.DataFrame(rows, columns=[*group, "bu", "bv", "m"])

    return run


def _translate(axis: int):
    """Shift box moments by ``step`` boxes along one axis into polynomial coefficients."""
    sign = np.array([(-1.0) ** j / math.factorial(j) for j in range(TERMS)])
    order = np.arange(TERMS)[:, None] + np.arange(TERMS)[None, :]
    table = {}
    for step in range(-REACH, REACH + 1):
        table[step] = _hermite(np.array(float(step)), 2 * TERMS)[order] * sign[None, :]

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            out = []
            for step, m in zip(pdf["step"], pdf["m"]):
                matrix = np.asarray(m).reshape(TERMS, TERMS)
                moved = table[step].T @ matrix if axis == 0 else matrix @ table[step]
                out.append(moved.ravel())
            yield pdf.drop(columns=["step", "m"]).assign(m=out)

    return run


def _sum_arrays(df: DataFrame, keys: list[str]) -> DataFrame:
    parts = df.select(*keys, F.posexplode("m").alias("i", "val")).groupBy(*keys, "i").agg(F.sum("val").alias("val"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "val")))  # TERMS^2 entries per box
    return parts.groupBy(*keys).agg(F.transform(ordered, lambda s: s["val"]).alias("m"))


def _grid_sums(points: DataFrame, group: list[str]) -> DataFrame:
    boxed = points.withColumns({"bu": F.floor("u").cast("long"), "bv": F.floor("v").cast("long")})
    box = [*group, "bu", "bv"]
    types = dict(boxed.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in box) + ", m array<double>"
    moments = _sum_arrays(boxed.select(*box, "u", "v").mapInPandas(_moments(group), schema), box)
    steps = F.explode(F.sequence(F.lit(-REACH), F.lit(REACH)))
    homes = boxed.select(*box).distinct()
    field = moments
    for axis, name in enumerate(("bu", "bv")):
        # target box = source box + step; D = target - source
        sent = field.withColumn("step", steps).withColumn(name, F.col(name) + F.col("step"))
        wanted = homes.select(*group, "bu").distinct() if axis == 0 else homes
        sent = sent.join(wanted, wanted.columns, "left_semi")
        field = _sum_arrays(sent.select(*box, "step", "m").mapInPandas(_translate(axis), schema), box)
    powers = lambda c, b: F.transform(
        F.sequence(F.lit(0), F.lit(TERMS - 1)), lambda j: F.pow(F.col(c) - F.col(b) - 0.5, j)
    )
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(TERMS - 1)), lambda j: F.slice(F.col("m"), j * TERMS + 1, TERMS)
    )
    field = field.select(*box, rows.alias("rows"))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    value = total(
        F.zip_with(
            "rows", powers("u", "bu"),
            lambda row, a: a * total(F.zip_with(row, F.col("_pv"), lambda c, p: c * p)),
        )
    )
    return (
        boxed.join(field, box)
        .withColumn("_pv", powers("v", "bv"))
        .select(*group, value.alias("s"))
    )


def kde_cv(points: DataFrame, group: list[str], direct_max: int = 1024) -> DataFrame:
    """``kde_summary`` per group; groups with a singular covariance are left out (NULL after a join)."""
    scaled = whitened(points, group)
    small = _pair_sums(scaled.filter(F.col("n") <= direct_max), group)
    sums = small.select(*group, "s")
    largest = points.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if largest > direct_max:
        sums = sums.unionByName(_grid_sums(scaled.filter(F.col("n") > direct_max), group))
    return _summary(sums, group)
