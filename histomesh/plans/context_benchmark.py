"""Does spatial context help? Modes x seeds of classifiers, their metrics and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.operators import classify as K
from histomesh.operators import evaluate as E
from histomesh.operators.labels import sample_split
from histomesh.session import durable


def predictions(
    patches: DataFrame, seeds: list[int], sizes: dict[str, int], n_classes: int, dim: int, modes=K.MODES, slide="slide_id", **fit
) -> DataFrame:
    """Held-out predictions ``(mode, seed, slide, patch, y_true, y_pred)``; splits are by slide."""
    out = None
    for seed in seeds:
        split = durable(sample_split(patches, slide, sizes, seed=seed))
        for mode in modes:
            part = durable(K.run_mode(patches, split, mode, n_classes, dim, slide, seed=seed, **fit).withColumn("seed", F.lit(seed)))
            out = part if out is None else out.unionByName(part)
    return out


def evaluate(pred: DataFrame, base: str = "none", n_bootstrap: int = 1000) -> dict[str, DataFrame]:
    """Metrics with intervals per (mode, seed), per-class tables, and the comparison to ``base``."""
    keys = ["mode", "seed"]
    conf = durable(E.confusion(pred, keys))
    classes = durable(E.per_class_metrics(conf, keys))
    metrics = durable(E.bootstrap_ci(pred, keys, n_bootstrap))
    return {
        "confusion": conf, "per_class": classes, "metrics": metrics, "collapsed": E.collapsed_classes(classes),
        "summary": E.seed_summary(metrics.select(*keys, "metric", "value"), base, "mode"),
        "per_class_summary": E.per_class_summary(classes, "mode"),
    }


def neighbour_count_sweep(patches: DataFrame, split: DataFrame, ks=(0, 4, 8, 16), n_classes: int = 11, dim: int = 768, **fit) -> DataFrame:
    """Metrics of the graph mode by number of neighbours; k = 0 is the plain head."""
    out = None
    for k in ks:
        part = durable(K.run_mode(patches, split, "graph", n_classes, dim, k=k, **fit).withColumn("k", F.lit(k)))
        out = part if out is None else out.unionByName(part)
    return E.classification_metrics(out, ["k"])
