"""Point-pattern statistics of each habitat inside each sample.

All functions return one row per ``(keys, habitat)`` for habitats with at least ``MIN_POINTS``
patches. The window of a sample is the bounding box of all its patches.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.operators.groups import WHOLE, by_whole_groups, column, nearest_squared
from histomesh.operators.kernel_density import kde_cv
from histomesh.operators.order import quantiles
from histomesh.operators.spatial import nearest_distance, radius_join
from histomesh.session import durable

MIN_POINTS = 10
RADII = (20.0, 50.0, 100.0, 200.0)
METRICS = [
    "ripley_k", "ripley_l", "pair_correlation", "g_function", "f_function", "j_function", "clark_evans",
    "quadrat_dispersion", "kde_summary",
]


def sample_windows(patches: DataFrame, keys) -> DataFrame:
    """Bounding box and area per sample."""
    w = patches.groupBy(*keys).agg(
        F.min("x_um").alias("x0"), F.max("x_um").alias("x1"), F.min("y_um").alias("y0"), F.max("y_um").alias("y1"),
        F.count(F.lit(1)).alias("n_all"),
    )
    width = F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-9))
    height = F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-9))
    return w.withColumn("area", F.when(F.col("n_all") >= 2, width * height))


def habitat_windows(patches: DataFrame, keys) -> DataFrame:
    """Sample window plus point count ``n`` of every habitat that has enough points."""
    counts = patches.groupBy(*keys, "habitat").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_POINTS)
    return counts.join(sample_windows(patches, keys), list(keys))


def _points(patches: DataFrame, keys) -> DataFrame:
    """Points of the habitats that pass the guard, with their distance to the window edge."""
    edge = F.least(
        F.col("x_um") - F.col("x0"), F.col("x1") - F.col("x_um"), F.col("y_um") - F.col("y0"), F.col("y1") - F.col("y_um")
    )
    windows = habitat_windows(patches, keys)
    return (
        patches.select(*keys, "habitat", "patch_id", "x_um", "y_um")
        .join(windows.select(*keys, "habitat", "x0", "x1", "y0", "y1"), [*keys, "habitat"])
        .select(*keys, "habitat", "patch_id", "x_um", "y_um", edge.alias("edge"))
    )


def _mean_of(columns: list[Column]) -> Column:
    """Mean of the non-NULL columns."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.when(count > 0, total / count)


def ripley_and_pair_correlation(patches: DataFrame, keys=("sample_id",), radii=RADII) -> DataFrame:
    """Border-corrected Ripley K and L, uncorrected K, and pair correlation.

    One radius join at the largest radius feeds all radii; its pairs are summed straight into one
    row per (sample, habitat) and never leave the join's task.
    """
    keys = list(keys)
    points = _points(patches, keys)
    group = [*keys, "habitat"]
    spots = points.groupBy(*group, F.col("x_um").alias("nx"), F.col("y_um").alias("ny")).agg(
        F.count(F.lit(1)).alias("w")
    )
    pairs = radius_join(points, spots, group, max(radii), ("x_um", "y_um"), ("nx", "ny"))
    sums, centres = [], []
    for i, r in enumerate(radii):
        near = F.col("d2") <= r * r
        sums.append(F.sum(F.when(near, F.col("w")).otherwise(0)).alias(f"all_{i}"))
        sums.append(F.sum(F.when(near & (F.col("edge") >= r), F.col("w")).otherwise(0)).alias(f"in_{i}"))
        centres.append(F.count_if(F.col("edge") >= r).alias(f"m_{i}"))
    table = (
        pairs.groupBy(*group).agg(*sums)
        .join(points.groupBy(*group).agg(*centres), group)
        .join(habitat_windows(patches, keys), group)
    )
    lam = F.col("n") / F.col("area")
    k_vals, l_vals, naive = [], [], []
    for i, r in enumerate(radii):
        mean_others = (F.col(f"in_{i}") - F.col(f"m_{i}")) / F.col(f"m_{i}")
        k = F.when((F.col(f"m_{i}") >= 5) & (lam > 0), mean_others / lam)
        k_vals.append(k)
        l_vals.append(F.sqrt(k / math.pi) - r)
        naive.append((F.col(f"all_{i}") - F.col("n")) / F.col("n") / lam)
    shells = [
        F.try_divide(
            (F.col(f"all_{i + 1}") - F.col(f"all_{i}")).cast("double"),
            F.col("n") * lam * F.lit(math.pi * (radii[i + 1] ** 2 - radii[i] ** 2)),
        )
        for i in range(len(radii) - 1)
    ]
    return table.select(
        *group,
        _mean_of(k_vals).alias("ripley_k"),
        _mean_of(l_vals).alias("ripley_l"),
        _mean_of(naive).alias("ripley_k_uncorrected"),
        _mean_of(shells).alias("pair_correlation"),
    )


def neighbour_distances(patches: DataFrame, keys=("sample_id",)) -> DataFrame:
    """Distance of every point to the nearest other point of its habitat."""
    points = durable(_points(patches, keys).select(*keys, "habitat", "patch_id", "x_um", "y_um"))
    right = points.select(
        *keys, "habitat", F.col("patch_id").alias("nbr_id"), F.col("x_um").alias("nx"), F.col("y_um").alias("ny")
    )
    return nearest_distance(
        points, right, [*keys, "habitat"], "patch_id", "nbr_id", ("x_um", "y_um"), ("nx", "ny"), exclude_self=True
    )


def g_function(nn: DataFrame, keys=("sample_id",)) -> DataFrame:
    return nn.groupBy(*keys, "habitat").agg(F.avg("nn_dist").alias("g_function"))


def clark_evans(nn: DataFrame, windows: DataFrame, keys=("sample_id",)) -> DataFrame:
    """Mean nearest distance over its random expectation with the perimeter correction."""
    group = [*keys, "habitat"]
    t = g_function(nn, keys).join(windows, group)
    perimeter = 2 * ((F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")))
    expected = 0.5 / F.sqrt(F.col("n") / F.col("area")) + (0.051 + 0.041 / F.sqrt("n")) * perimeter / F.col("n")
    return t.select(*group, F.when(expected > 0, F.col("g_function") / expected).alias("clark_evans"))


def unit_probes(n: int = 500, seed: int = 42) -> list[tuple[float, float]]:
    """Uniform points of the unit square, the same for every sample."""
    return [tuple(p) for p in np.random.default_rng(seed).random((n, 2)).tolist()]


def probe_distances(patches: DataFrame, keys=("sample_id",), probes=None) -> DataFrame:
    """Distance from each window probe to the nearest point of every habitat.

    Probes of habitats of ``WHOLE`` points at most are made and measured in the task that has the points.
    """
    probes = probes or unit_probes()
    keys = list(keys)
    group = [*keys, "habitat"]
    windows = durable(habitat_windows(patches, keys))
    points = patches.select(*group, "patch_id", "x_um", "y_um")
    small = windows.filter(F.col("n") <= WHOLE).select(*group, "x0", "x1", "y0", "y1")
    near = _probed_in_tasks(points.join(small, group).drop("patch_id"), group, np.array(probes, float).reshape(-1, 2))
    large = windows.filter(F.col("n") > WHOLE)
    if large.isEmpty():
        return near
    table = F.lit([c for p in probes for c in p])  # fixed size: 2 doubles per probe
    i = F.col("probe")
    placed = large.withColumn("probe", F.explode(F.sequence(F.lit(0), F.lit(len(probes) - 1)))).select(
        *group, "probe",
        (F.col("x0") + (F.col("x1") - F.col("x0")) * F.element_at(table, 2 * i + 1)).alias("px"),
        (F.col("y0") + (F.col("y1") - F.col("y0")) * F.element_at(table, 2 * i + 2)).alias("py"),
    )
    points = durable(points.join(large.select(*group), group))
    placed = durable(placed)
    rest = nearest_distance(placed, points, group, "probe", "patch_id", ("px", "py"), ("x_um", "y_um"))
    return near.unionByName(rest.select(*group, "probe", "nn_dist"))


def _probed_in_tasks(points: DataFrame, group: list[str], unit: np.ndarray) -> DataFrame:
    def measure(table: pa.Table, starts: np.ndarray) -> pa.Table | None:
        x, y, x0, x1, y0, y1 = (column(table, c) for c in ("x_um", "y_um", "x0", "x1", "y0", "y1"))
        lead, found = [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            known = np.isfinite(x[a:b]) & np.isfinite(y[a:b])
            if known.any():
                px, py = x0[a] + (x1[a] - x0[a]) * unit[:, 0], y0[a] + (y1[a] - y0[a]) * unit[:, 1]
                found.append(nearest_squared(x[a:b][known], y[a:b][known], px, py))
                lead.append(a)
        if not lead:
            return None
        take = pa.array(np.repeat(lead, len(unit)))
        kept = [table.column(k).take(take).combine_chunks() for k in group]
        probe = np.tile(np.arange(len(unit), dtype=np.int32), len(lead))
        return pa.Table.from_arrays([*kept, pa.array(probe), pa.array(np.sqrt(np.concatenate(found)))], [*group, "probe", "nn_dist"])

    kinds = dict(points.dtypes)
    return by_whole_groups(points, group, [], measure, ", ".join(f"`{k}` {kinds[k]}" for k in group) + ", probe int, nn_dist double")


def f_function(probe_dist: DataFrame, keys=("sample_id",)) -> DataFrame:
    return probe_dist.groupBy(*keys, "habitat").agg(F.avg("nn_dist").alias("f_function"))


def j_function(nn: DataFrame, probe_dist: DataFrame, keys=("sample_id",)) -> DataFrame:
    """(1 - G) / (1 - F) at the median nearest-neighbour distance; NULL when F reaches 1."""
    group = [*keys, "habitat"]
    median = quantiles(nn, group, "nn_dist", {"r": 0.5})
    within = lambda d: F.avg((F.col("nn_dist") <= F.col("r")).cast("double"))
    g = nn.join(median, group).groupBy(*group).agg(within(nn).alias("g"))
    f = probe_dist.join(median, group).groupBy(*group).agg(within(probe_dist).alias("f"))
    rest = 1 - F.col("f")
    return g.join(f, group).select(*group, F.when(rest > 1e-9, (1 - F.col("g")) / rest).alias("j_function"))


def quadrat_vmr(patches: DataFrame, keys=("sample_id",), grid: int = 8) -> DataFrame:
    """Variance-to-mean ratio of counts on a grid over the window, empty quadrats included."""
    group = [*keys, "habitat"]

    def slot(value, lo, hi):
        step = (F.col(hi) - F.col(lo)) / grid
        passed = [(F.col(value) >= F.col(lo) + F.lit(float(i)) * step).cast("int") for i in range(1, grid)]
        return reduce(lambda a, b: a + b, passed)

    placed = patches.select(*group, "x_um", "y_um").join(habitat_windows(patches, keys), group)
    cells = placed.groupBy(*group, slot("x_um", "x0", "x1").alias("qx"), slot("y_um", "y0", "y1").alias("qy")).agg(
        F.count(F.lit(1)).alias("c")
    )
    m = F.sum("c") / F.lit(float(grid * grid))
    var = F.sum(F.col("c") * F.col("c")) / F.lit(float(grid * grid)) - m * m
    return cells.groupBy(*group).agg((var / m).alias("quadrat_dispersion"))


def dispersion_table(patches: DataFrame, keys=("sample_id",), probes=None) -> DataFrame:
    """All nine dispersion metrics, wide, one row per (sample, habitat) passing the guard."""
    keys = list(keys)
    group = [*keys, "habitat"]
    windows = habitat_windows(patches, keys)
    nn = neighbour_distances(patches, keys)
    probe = probe_distances(patches, keys, probes)
    out = windows.select(*group)
    for block in (
        ripley_and_pair_correlation(patches, keys).drop("ripley_k_uncorrected"),
        g_function(nn, keys),
        f_function(probe, keys),
        j_function(nn, probe, keys),
        clark_evans(nn, windows, keys),
        quadrat_vmr(patches, keys),
        kde_cv(patches.join(windows.select(*group), group, "left_semi"), group),
    ):
        out = out.join(block, group, "left")
    return out


def dispersion_features(patches: DataFrame, keys=("sample_id",), probes=None) -> DataFrame:
    long = dispersion_table(patches, keys, probes).unpivot([*keys, "habitat"], METRICS, "metric", "value")
    name = F.concat(F.format_string("disp_H%02d_", F.col("habitat") + 1), F.col("metric"))
    return long.select(*keys, name.alias("feature"), "value")


def dispersion_with_guard(patches: DataFrame, keys=("sample_id",), n_habitats: int = 10) -> DataFrame:
    """Every (sample, habitat) with its count; metrics are defined only where ``passes`` is true."""
    present = patches.groupBy(*keys, "habitat").agg(F.count(F.lit(1)).alias("n"))
    scaffold = (
        patches.select(*keys).distinct().withColumn("habitat", F.explode(F.lit(list(range(n_habitats)))))
    )
    n = F.coalesce("n", F.lit(0))
    return scaffold.join(present, [*keys, "habitat"], "left").select(
        *keys, "habitat", n.alias("n"), (n >= MIN_POINTS).alias("passes")
    )
