"""Patches on a regular lattice: stride, windows, pyramids and neighbourhood context vectors."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomesh.functions.vectors import dot, doubles, max_vector, mean_vector
from histomesh.operators.spatial import knn_join, nearest_distance

MIN_SLIDE_PATCHES = 3


def to_lattice(patches: DataFrame, stride: float, slide="slide_id", xy=("x_um", "y_um")) -> DataFrame:
    """Integer ``row`` (from y) and ``col`` (from x) relative to the slide's corner, half to even."""
    x, y = xy
    corner = patches.groupBy(slide).agg(F.min(x).alias("_x0"), F.min(y).alias("_y0"))
    return (
        patches.join(corner, slide)
        .withColumn("row", F.bround((F.col(y) - F.col("_y0")) / stride).cast("long"))
        .withColumn("col", F.bround((F.col(x) - F.col("_x0")) / stride).cast("long"))
        .drop("_x0", "_y0")
    )


def infer_stride(patches: DataFrame, slide="slide_id", patch="patch_id", xy=("x_um", "y_um"), bins: int = 50) -> DataFrame:
    """Modal nearest-neighbour distance per slide: midpoint of the first fullest of ``bins`` bins."""
    x, y = xy
    points = patches.select(slide, patch, x, y)
    right = points.select(slide, F.col(patch).alias("nbr_id"), F.col(x).alias("nx"), F.col(y).alias("ny"))
    nn = nearest_distance(points, right, [slide], patch, "nbr_id", xy, ("nx", "ny"), exclude_self=True)
    nn = nn.filter(F.col("nn_dist") > 0).select(slide, F.col("nn_dist").alias("d"))
    per_slide = nn.groupBy(slide).agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n"))
    flat = F.col("hi") == F.col("lo")
    lo = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins
    ranged = nn.join(per_slide.filter(F.col("n") >= MIN_SLIDE_PATCHES).select(slide, lo.alias("lo"), width.alias("w")), slide)
    slot = F.least(F.lit(bins - 1), F.floor((F.col("d") - F.col("lo")) / F.col("w"))).cast("int")
    hist = ranged.groupBy(slide, "lo", "w", slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    best = hist.groupBy(slide, "lo", "w").agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("_b"))
    return best.select(slide, (F.col("lo") + (-F.col("_b.b") + 0.5) * F.col("w")).alias("stride_um"))


def one_per_slot(patches: DataFrame, slide="slide_id", patch="patch_id") -> DataFrame:
    """On a collision the largest patch id keeps the slot."""
    others = [c for c in patches.columns if c not in (slide, "row", "col")]
    winner = F.max_by(F.struct(*others), F.col(patch)).alias("_w")
    return patches.groupBy(slide, "row", "col").agg(winner).select(slide, "row", "col", "_w.*")


def lattice_stats(patches: DataFrame, slide="slide_id") -> DataFrame:
    """Height, width, occupied slots, occupancy and collisions per slide."""
    slots = patches.groupBy(slide, "row", "col").agg(F.count(F.lit(1)).alias("n"))
    h, w = F.max("row") + 1, F.max("col") + 1
    return slots.groupBy(slide).agg(
        h.alias("height"), w.alias("width"), F.count(F.lit(1)).alias("occupied"),
        (F.count(F.lit(1)) / (h * w)).alias("occupancy"), (F.sum("n") - F.count(F.lit(1))).alias("collisions"),
    )


def _offsets(window: int):
    if window % 2 == 0:
        raise ValueError("window must be odd")
    return F.explode(F.sequence(F.lit(-(window // 2)), F.lit(window // 2)))


def lattice_window_join(patches: DataFrame, window: int, slide="slide_id", patch="patch_id") -> DataFrame:
    """Every slot of the window around each patch: ``dr, dc, nbr_id`` and ``valid``."""
    bank = one_per_slot(patches.select(slide, "row", "col", patch), slide, patch)
    wanted = (
        patches.select(slide, patch, "row", "col")
        .withColumn("dr", _offsets(window)).withColumn("dc", _offsets(window))
        .select(slide, patch, "dr", "dc", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
    )
    found = wanted.join(bank.withColumnRenamed(patch, "nbr_id"), [slide, "row", "col"], "left")
    return found.select(slide, patch, "dr", "dc", "nbr_id", F.col("nbr_id").isNotNull().alias("valid"))


def pyramid_pool(patches: DataFrame, n_scales: int, slide="slide_id", patch="patch_id", vector="embedding") -> DataFrame:
    """``(slide, scale, row, col, n, embedding)``: mean over the occupied slots of 2^s x 2^s blocks."""
    base = one_per_slot(patches.select(slide, "row", "col", patch, vector), slide, patch)
    blocks = base.withColumn("scale", F.explode(F.sequence(F.lit(0), F.lit(n_scales - 1))))
    # dividing by a power of two keeps the lattice aligned with its parents
    block = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("scale"))).cast("long")
    return blocks.groupBy(slide, "scale", block("row").alias("row"), block("col").alias("col")).agg(
        F.count(F.lit(1)).alias("n"), mean_vector(vector).alias(vector)
    )


def scale_window_join(
    patches: DataFrame, pyramid: DataFrame, window: int, n_scales: int, slide="slide_id", patch="patch_id", vector="embedding"
) -> DataFrame:
    """Window slots around each patch at every scale, with the pooled vector where occupied.

    Slides with under three patches give only the centre slot.
    """
    sizes = patches.groupBy(slide).agg((F.count(F.lit(1)) >= MIN_SLIDE_PATCHES).alias("_big"))
    scale = F.explode(F.sequence(F.lit(0), F.lit(n_scales - 1)))
    block = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("scale"))).cast("long")
    wanted = (
        patches.select(slide, patch, "row", "col").join(sizes, slide)
        .withColumn("scale", scale).withColumn("dr", _offsets(window)).withColumn("dc", _offsets(window))
        .filter(F.col("_big") | ((F.col("dr") == 0) & (F.col("dc") == 0)))
        .select(slide, patch, "scale", "dr", "dc", (block("row") + F.col("dr")).alias("row"), (block("col") + F.col("dc")).alias("col"))
    )
    found = wanted.join(pyramid.select(slide, "scale", "row", "col", vector), [slide, "scale", "row", "col"], "left")
    return found.select(slide, patch, "scale", "dr", "dc", vector, F.col(vector).isNotNull().alias("valid"))


def neighbours(
    patches: DataFrame, k: int, radius: float = 300.0, slide="slide_id", patch="patch_id", vector="embedding", xy=("x_um", "y_um")
) -> DataFrame:
    """Up to ``k`` nearest patches within ``radius`` on the same slide, with both vectors."""
    points = patches.select(slide, patch, *xy, vector)
    right = patches.select(
        slide, F.col(patch).alias("nbr_id"), F.col(xy[0]).alias("nx"), F.col(xy[1]).alias("ny"), F.col(vector).alias("nbr_vec")
    )
    # ids first, vectors after: only the k kept neighbours pay for their vectors
    links = knn_join(
        points.drop(vector), right.drop("nbr_vec"), [slide], k, patch, "nbr_id", xy, ("nx", "ny"),
        exclude_self=True, max_radius=radius,
    ).select(slide, patch, "nbr_id", "rank", F.sqrt("d2").alias("dist"))
    return links.join(points.select(slide, patch, vector), [slide, patch]).join(
        right.select(slide, "nbr_id", "nbr_vec"), [slide, "nbr_id"]
    )


def deepset_pool(patches: DataFrame, links: DataFrame, dim: int, slide="slide_id", patch="patch_id") -> DataFrame:
    """Mean and maximum over neighbour vectors; zeros where a patch has none."""
    pooled = links.groupBy(slide, patch).agg(mean_vector("nbr_vec").alias("mean"), max_vector("nbr_vec").alias("max"))
    zeros = F.lit([0.0] * dim)
    joined = patches.select(slide, patch).join(pooled, [slide, patch], "left")
    return joined.select(slide, patch, F.coalesce("mean", zeros).alias("mean"), F.coalesce("max", zeros).alias("max"))


@dataclass(frozen=True)
class AttentionWeights:
    """Linear layers of an attention head: matrices (out x in) and biases (out)."""

    query: tuple[np.ndarray, np.ndarray]
    key: tuple[np.ndarray, np.ndarray]
    value: tuple[np.ndarray, np.ndarray]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Query and key layers as one on the centre: its dot product with a neighbour's vector is the scaled
        logit, but for a term that all neighbours of a centre share and softmax cancels."""
        (q, q0), (k, _) = self.query, self.key
        scale = float(np.shape(q)[0]) ** -0.5
        return np.transpose(k) @ np.asarray(q) * scale, np.transpose(k) @ np.asarray(q0) * scale


def _linear(layer: tuple[np.ndarray, np.ndarray], vector) -> Column:
    matrix, bias = (F.from_json(F.lit(json.dumps(np.asarray(m, dtype=float).tolist())), kind) for m, kind in zip(layer, ("array<array<double>>", "array<double>")))
    return F.zip_with(F.transform(matrix, lambda row: dot(row, vector)), bias, lambda a, b: a + b)


def attention_map(
    links: DataFrame, dim: int, beta: float = 1.0, slide="slide_id", patch="patch_id", vector="embedding", weights: AttentionWeights | None = None
) -> DataFrame:
    """Softmax weight of every neighbour: scaled dot product minus a log-distance penalty.

    With ``weights`` the dot product is that of the query of the patch and the key of the neighbour.
    Both layers are applied once per patch, not per link. ``beta`` 0 leaves distance out.
    """
    if weights is None:
        logit = dot(vector, "nbr_vec") / F.lit(float(dim) ** 0.5)
    else:
        heads = links.groupBy(slide, patch).agg(F.first(vector).alias("_c")).select(slide, patch, _linear(weights.centre(), "_c").alias("_q"))
        links = links.join(heads, [slide, patch])
        logit = dot("_q", "nbr_vec")
    logit = logit - beta * F.log1p(F.col("dist") / 100.0)
    mine = Window.partitionBy(slide, patch)  # at most k rows
    shifted = links.withColumn("_l", logit).withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(mine)))
    return shifted.withColumn("weight", F.col("_e") / F.sum("_e").over(mine)).drop("_l", "_e", "_q")


def distance_attention(
    patches: DataFrame, links: DataFrame, dim: int, beta: float = 1.0, slide="slide_id", patch="patch_id", vector="embedding",
    weights: AttentionWeights | None = None,
) -> DataFrame:
    """Attention-weighted mean of neighbour vectors, through the value layer of ``weights`` if given;
    zeros where a patch has none."""
    mapped = attention_map(links, dim, beta, slide, patch, vector, weights)
    # the weights sum to one, so the weighted mean is the attention output, and the value layer may follow it
    mixed = mapped.groupBy(slide, patch).agg(mean_vector("nbr_vec", "weight").alias("context"))
    if weights is not None:
        dim = int(np.shape(weights.value[0])[0])
        mixed = mixed.withColumn("context", _linear(weights.value, "context"))
    joined = patches.select(slide, patch).join(mixed, [slide, patch], "left")
    return joined.select(slide, patch, F.coalesce("context", F.lit([0.0] * dim)).alias("context"))


def grid_context_vector(slots: DataFrame, dim: int, slide="slide_id", patch="patch_id", vector="embedding") -> DataFrame:
    """Flattened masked window (zeros where empty), its mask, and the mean over valid slots.

    ``slots`` comes from ``scale_window_join``; a patch has S x W x W of them.
    """
    zeros = F.lit([0.0] * dim)
    entry = F.struct("scale", "dr", "dc", F.coalesce(doubles(vector), zeros).alias("v"), F.col("valid").cast("int").alias("m"))
    ordered = slots.groupBy(slide, patch).agg(
        F.array_sort(F.collect_list(entry)).alias("_s"),
        F.count_if("valid").alias("n_valid"),
    )
    means = slots.filter("valid").groupBy(slide, patch).agg(mean_vector(vector).alias("mean"))
    return ordered.join(means, [slide, patch], "left").select(
        slide, patch, "n_valid",
        F.flatten(F.transform("_s", lambda s: s["v"])).alias("window"),
        F.transform("_s", lambda s: s["m"]).alias("mask"),
        F.coalesce("mean", zeros).alias("mean"),
    )
