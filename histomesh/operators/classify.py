"""Habitat classifiers on embeddings with optional spatial context."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.functions.vectors import doubles
from histomesh.operators import lattice
from histomesh.operators.labels import balanced_resample
from histomesh.session import durable

MODES = ("none", "graph", "grid2d", "grid3d")


def context_vectors(
    patches: DataFrame, mode: str, dim: int, k: int = 8, radius: float = 300.0, window: int = 3, n_scales: int = 3, beta: float = 1.0,
    slide="slide_id", patch="patch_id",
) -> DataFrame:
    """``(slide, patch, label, x)``: the embedding followed by its context. ``graph`` with k = 0 is ``none``.

    Context is built only from the given rows, so build it per split to keep splits apart.
    """
    own = patches.select(slide, patch, "label", doubles("embedding").alias("embedding"))
    if mode == "none" or (mode == "graph" and k == 0):
        return own.select(slide, patch, "label", F.col("embedding").alias("x"))
    if mode == "graph":
        links = durable(lattice.neighbours(patches, k, radius, slide, patch))
        pooled = lattice.deepset_pool(patches, links, dim, slide, patch)
        mixed = lattice.distance_attention(patches, links, dim, beta, slide, patch)
        joined = own.join(pooled, [slide, patch]).join(mixed, [slide, patch])
        return joined.select(slide, patch, "label", F.concat("embedding", "mean", "max", "context").alias("x"))
    if mode not in ("grid2d", "grid3d"):
        raise ValueError(f"unknown mode {mode!r}")
    scales = 1 if mode == "grid2d" else n_scales
    pyramid = lattice.pyramid_pool(patches, scales, slide, patch)
    slots = lattice.scale_window_join(patches, pyramid, window, scales, slide, patch)
    grid = lattice.grid_context_vector(slots, dim, slide, patch)
    joined = own.join(grid, [slide, patch])
    # a slide with under three patches has one slot per scale; pad to the full window
    width = scales * window * window
    pad = lambda c, n: F.slice(F.concat(F.col(c), F.array_repeat(F.lit(0.0), n)), 1, n)
    return joined.select(
        slide, patch, "label",
        F.concat("embedding", "mean", pad("window", width * dim), pad("mask", width)).alias("x"),
    )


def train_habitat_classifier(
    train: DataFrame, n_classes: int, hidden=(256, 128), max_iter: int = 30, balanced: bool = True, slide="slide_id", patch="patch_id",
    seed: int = 42,
):
    """Feed-forward head on ``x``; balanced training draws every class equally often."""
    rows = balanced_resample(train, "label", [slide, patch], seed) if balanced else train
    data = durable(rows.select(F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features")))
    width = data.first()["features"].size
    model = MultilayerPerceptronClassifier(layers=[width, *hidden, n_classes], maxIter=max_iter, seed=seed)
    return model.fit(data)


def predict(model, df: DataFrame, slide="slide_id", patch="patch_id") -> DataFrame:
    scored = model.transform(df.withColumn("features", array_to_vector("x")))
    return scored.select(slide, patch, F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))


def run_mode(
    patches: DataFrame, split: DataFrame, mode: str, n_classes: int, dim: int, slide="slide_id", patch="patch_id", max_iter: int = 30,
    hidden=(256, 128), seed: int = 42, **context,
) -> DataFrame:
    """Held-out predictions of one mode; context never crosses slides or splits."""
    tagged = patches.join(split, slide)
    parts = {
        name: context_vectors(durable(tagged.filter(F.col("split") == name).drop("split")), mode, dim, slide=slide, patch=patch, **context)
        for name in ("train", "val")
    }
    model = train_habitat_classifier(parts["train"], n_classes, hidden, max_iter, slide=slide, patch=patch, seed=seed)
    return predict(model, parts["val"], slide, patch).withColumn("mode", F.lit(mode))


def predict_habitat(df: DataFrame, weights: list[tuple[np.ndarray, np.ndarray]], tumour_classes: list[int], vector="embedding") -> DataFrame:
    """Apply a trained three-layer head: adds ``habitat``, ``confidence`` and ``tumour_prob``."""
    layers = [(np.asarray(w, dtype=float), np.asarray(b, dtype=float)) for w, b in weights]

    @F.pandas_udf("habitat int, confidence double, tumour_prob double")
    def head(v: pd.Series) -> pd.DataFrame:
        h = np.stack([np.asarray(x, dtype=float) for x in v])
        for i, (w, b) in enumerate(layers):
            h = h @ w + b
            if i < len(layers) - 1:
                h = np.maximum(h, 0.0)
        e = np.exp(h - h.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        return pd.DataFrame({"habitat": p.argmax(axis=1), "confidence": p.max(axis=1), "tumour_prob": p[:, tumour_classes].sum(axis=1)})

    return df.withColumn("_p", head(F.col(vector))).select(*df.columns, "_p.habitat", "_p.confidence", "_p.tumour_prob")
