"""Label transfer between modalities, patch labels, splits and subsampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomesh.functions.vectors import cosine
from histomesh.operators.order import quantiles, row_positions
from histomesh.operators.spatial import knn_join

# Fixed values of the patch rule.
BACKGROUND_MAX_CELLS = 5
INFORMATIVE_MIN_CELLS = 15
DOMINANT_FRACTION = 0.60


def apply_affine(df: DataFrame, affine: list[list[float]], xy=("x_um", "y_um"), out=("x_px", "y_px")) -> DataFrame:
    """``out = A . [x, y, 1]`` for one fixed 2 x 3 matrix."""
    x, y = F.col(xy[0]), F.col(xy[1])
    return df.withColumns({name: row[0] * x + row[1] * y + row[2] for name, row in zip(out, affine)})


def apply_affine_table(df: DataFrame, affines: DataFrame, on: list[str], xy=("x_um", "y_um"), out=("x_px", "y_px")) -> DataFrame:
    """One matrix per sample, columns ``a00 a01 a02 a10 a11 a12``."""
    x, y = F.col(xy[0]), F.col(xy[1])
    joined = df.join(affines, on)
    placed = {
        name: F.col(f"a{i}0") * x + F.col(f"a{i}1") * y + F.col(f"a{i}2") for i, name in enumerate(out)
    }
    return joined.withColumns(placed).drop(*[f"a{i}{j}" for i in range(2) for j in range(3)])


def transfer_labels(
    nuclei: DataFrame, cells: DataFrame, affine, mpp: float, max_um: float = 5.0, on=("sample_id",),
    nucleus="nucleus_id", cell="cell_id", label="cn",
) -> DataFrame:
    """Nearest projected cell of every nucleus; its label within ``max_um``, else -1."""
    on = list(on)
    projected = apply_affine(cells, affine, out=("_cx", "_cy")).select(
        *on, F.col(cell).alias("match_id"), F.col(label).alias("_label"), "_cx", "_cy"
    )
    near = knn_join(nuclei, projected, on, 1, nucleus, "match_id", ("x_px", "y_px"), ("_cx", "_cy"))
    dist = F.sqrt("d2") * mpp
    return near.select(
        *nuclei.columns, "match_id", dist.alias("match_distance_um"),
        F.when(dist <= max_um, F.col("_label")).otherwise(-1).cast("int").alias(label),
    )


def matched_fraction(transferred: DataFrame, label="cn", warn_below: float = 0.30) -> DataFrame:
    share = F.avg((F.col(label) >= 0).cast("double"))
    return transferred.agg(F.count(F.lit(1)).alias("n"), share.alias("matched"), (share < warn_below).alias("suspicious"))


def _dominant(points: DataFrame, group: list[str], label: str) -> DataFrame:
    """Size, most frequent label (lowest on ties) and its share, per group."""
    counts = points.groupBy(*group, label).agg(F.count(F.lit(1)).alias("_n"))
    top = F.max_by(F.col(label), F.struct(F.col("_n"), -F.col("_order")))
    rank = F.dense_rank().over(Window.partitionBy(*group).orderBy(label)) if dict(points.dtypes)[label] == "string" else F.col(label)
    return counts.withColumn("_order", rank).groupBy(*group).agg(
        F.sum("_n").alias("n_cells"), top.alias("top_label"), (F.max("_n") / F.sum("_n")).alias("dominant_frac")
    )


def patch_of(px: str, size: float) -> Column:
    return F.floor(F.col(px) / F.lit(float(size))).cast("long")


def label_patches(
    nuclei: DataFrame, patch_px: float, n_habitats: int = 10, on=("sample_id",), xy=("x_px", "y_px"), label="cn"
) -> DataFrame:
    """Few annotated cells make background, a clear majority makes a label, the rest is dropped."""
    group = [*on, "patch_x", "patch_y"]
    placed = nuclei.filter(F.col(label) >= 0).select(
        *on, patch_of(xy[0], patch_px).alias("patch_x"), patch_of(xy[1], patch_px).alias("patch_y"), label
    )
    per_patch = _dominant(placed, group, label)
    n, share = F.col("n_cells"), F.col("dominant_frac")
    final = (
        F.when(n <= BACKGROUND_MAX_CELLS, F.lit(n_habitats))
        .when((n > INFORMATIVE_MIN_CELLS) & (share >= DOMINANT_FRACTION), F.col("top_label"))
    )
    labelled = per_patch.withColumn("label", final.cast("int")).filter(F.col("label").isNotNull())
    return labelled.select(*group, "label", "n_cells", "dominant_frac")


def patch_lineage_summary(
    cells: DataFrame, patch_px: float, min_cells: int = 25, on=("sample_id",), xy=("x_px", "y_px"), label="lineage"
) -> DataFrame:
    group = [*on, "patch_x", "patch_y"]
    placed = cells.select(*on, patch_of(xy[0], patch_px).alias("patch_x"), patch_of(xy[1], patch_px).alias("patch_y"), label)
    out = _dominant(placed, group, label).filter(F.col("n_cells") >= min_cells)
    return out.withColumnsRenamed({"top_label": "dominant", "dominant_frac": "purity"})


def patch_label_report(patches: DataFrame, by: list[str] = ("label",)) -> DataFrame:
    """Per label (and split): count, percent of all, median cells and median dominant share."""
    by = list(by)
    counts = patches.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    pct = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per label
    cells = quantiles(patches, by, "n_cells", {"median_cells": 0.5})
    share = quantiles(patches, by, "dominant_frac", {"median_dominant_frac": 0.5})
    return counts.withColumn("pct", pct).join(cells, by).join(share, by)


def contiguous_cap(patches: DataFrame, n: int, on=("sample_id",), xy=("patch_x", "patch_y")) -> DataFrame:
    """The ``n`` patches of each sample nearest to its median lattice position."""
    on, (x, y) = list(on), xy
    centre = quantiles(patches, on, x, {"_cx": 0.5}).join(quantiles(patches, on, y, {"_cy": 0.5}), on)
    dx, dy = F.col(x) - F.col("_cx"), F.col(y) - F.col("_cy")
    ranked = row_positions(patches.join(centre, on).withColumn("_d2", dx * dx + dy * dy), on, ["_d2", x, y], "_pos")
    return ranked.filter(F.col("_pos") < n).select(*patches.columns)


def grid_subsample(df: DataFrame, n: int, on: list[str], order: list[str]) -> DataFrame:
    """``n`` evenly spaced rows of each group in raster order, first and last included."""
    placed = row_positions(df, on, order, "_pos")
    sizes = placed.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    step = F.bround(F.col("_i") * (F.col("_n") - 1) / F.lit(float(max(n - 1, 1)))).cast("long")
    picks = (
        sizes.filter(F.col("_n") > n)
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .select(*on, step.alias("_pos"))
        .distinct()
    )
    small = sizes.filter(F.col("_n") <= n).select(*on)
    kept = placed.join(picks, [*on, "_pos"], "left_semi").unionByName(placed.join(small, on, "left_semi"))
    return kept.select(*df.columns)


def sample_split(
    df: DataFrame, sample: str, sizes: dict[str, int], order_key: Column | None = None, seed: int = 42
) -> DataFrame:
    """One row per sample with its split; whole samples only, the surplus is 'unused'."""
    key = order_key if order_key is not None else F.xxhash64(F.lit(seed), F.col(sample))
    ids = df.select(sample).distinct().withColumn("_k", key)
    placed = row_positions(ids, [], ["_k", sample], "_pos")
    total, split = 0, None
    for name, size in sizes.items():
        total += size
        split = F.when(F.col("_pos") < total, name) if split is None else split.when(F.col("_pos") < total, name)
    if placed.limit(total).count() < total:
        raise ValueError(f"need {total} samples for the split {sizes}")
    return placed.select(sample, split.otherwise("unused").alias("split"))


def split_leaks(assigned: DataFrame, sample: str) -> DataFrame:
    """Samples that occur in more than one split; empty when the split is clean."""
    return assigned.groupBy(sample).agg(F.count_distinct("split").alias("n_splits")).filter(F.col("n_splits") > 1)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Every row with weight 1 / (class count), each class weighing the same in total."""
    counts = df.groupBy(label).agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    return df.join(counts, label)  # broadcast by its size, if at all


def balanced_resample(df: DataFrame, label: str, id_col: str | list[str], seed: int = 42) -> DataFrame:
    """About as many rows as ``df``, each class equally likely, drawn with replacement.

    Each row is repeated a Poisson number of times with its class's mean; the draw depends only on
    (seed, ids), so a recomputed task draws the same rows. ``id_col`` names the columns that identify
    a row. A large mean is the sum of parts of at most 50, drawn one by one, so no probability
    underflows however rare a class is.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    stats = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c")).withColumn("_one", F.lit(1))
    whole = stats.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k")).withColumn("_one", F.lit(1))  # one row
    rates = stats.join(whole, "_one").select(label, (F.col("_n") / F.col("_k") / F.col("_c")).alias("_rate"))
    rates = rates.withColumn("_parts", F.ceil(F.col("_rate") / 50.0).cast("int"))
    part = F.col("_rate") / F.col("_parts")

    def poisson(j):
        uniform = (F.pmod(F.xxhash64(F.lit(seed), *ids, j), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        # walk the distribution until it passes the uniform draw; past 2 * part + 40 nothing is left
        steps = F.sequence(F.lit(1), F.ceil(part * 2 + 40).cast("int"))
        walked = F.aggregate(
            steps,
            F.struct(F.lit(0).alias("k"), F.exp(-part).alias("p"), F.exp(-part).alias("cdf"), uniform.alias("u")),
            lambda s, i: F.struct(
                F.when(s["cdf"] < s["u"], i).otherwise(s["k"]).alias("k"), (s["p"] * part / i).alias("p"),
                (s["cdf"] + s["p"] * part / i).alias("cdf"), s["u"].alias("u"),
            ),
        )
        return walked["k"]

    draws = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("_parts")), poisson), F.lit(0), lambda a, k: a + k)
    # adaptive execution broadcasts the rates where they are few and splits a class that is large
    drawn = df.join(rates, label).withColumn("_k", draws)
    return drawn.filter(F.col("_k") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_k")))).select(*df.columns, "copy")


def pooled_fit_sample(df: DataFrame, n: int, id_cols: list[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all), uniform and reproducible: the smallest keyed hashes."""
    total = df.count()
    if total <= n:
        return df
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *id_cols))
    # a generous hash cut first, so that only about n rows are ordered
    share = min(1.0, (n + 6.0 * n**0.5 + 100) / total)
    cut = int(-(2**63) + share * 2**64)
    near = hashed.filter(F.col("_h") <= min(cut, 2**63 - 1))
    return row_positions(near, [], ["_h", *id_cols], "_pos").filter(F.col("_pos") < n).drop("_pos", "_h")


def nearest_centroid(points: DataFrame, centroids: DataFrame, vector="embedding", name="name", centroid="centroid") -> DataFrame:
    """Most similar centroid by cosine, first name on ties, similarity kept as ``confidence``.

    Centroids are one row per class; they travel as one array built from that bounded table.
    """
    rows = centroids.select(name, centroid).orderBy(name).limit(10001).collect()
    if len(rows) > 10000:
        raise ValueError("nearest_centroid expects class centroids, not a point table")
    options = F.array(
        *[F.struct(F.lit(r[name]).alias("name"), F.lit([float(v) for v in r[centroid]]).alias("c")) for r in rows]
    )
    best = F.aggregate(
        options,
        F.struct(F.lit(rows[0][name]).alias("name"), F.lit(float("-inf")).alias("sim")),
        lambda acc, o: F.when(
            cosine(F.col(vector), o["c"]) > acc["sim"],
            F.struct(o["name"].alias("name"), cosine(F.col(vector), o["c"]).alias("sim")),
        ).otherwise(acc),
    )
    return points.withColumn("_b", best).select(
        *points.columns, F.col("_b.name").alias(name), F.col("_b.sim").alias("confidence")
    )
