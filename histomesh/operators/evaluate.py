"""Classifier evaluation from confusion counts, bootstrap intervals and seed comparisons.

Everything after the confusion table is bounded by the number of classes, seeds and modes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomesh.functions.tails import normal_two_sided

COLLAPSED_RECALL = 0.10


def confusion(predictions: DataFrame, keys=(), y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Long confusion counts with row fractions; the only step that reads all predictions."""
    keys = list(keys)
    counts = predictions.groupBy(*keys, y_true, y_pred).agg(F.count(F.lit(1)).alias("n"))
    row = Window.partitionBy(*keys, y_true)
    return counts.withColumn("row_frac", F.col("n") / F.sum("n").over(row))


def per_class_metrics(conf: DataFrame, keys=(), y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Precision, recall, F1 and support per class occurring in truth or prediction."""
    keys = list(keys)
    side = F.explode(
        F.array(
            F.struct(F.col(y_true).alias("class"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("said")),
            F.struct(F.col(y_pred).alias("class"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("said")),
        )
    )
    hit = F.when(F.col(y_true) == F.col(y_pred), F.col("n")).otherwise(0)
    # the diagonal count rides on the truth side only
    rows = conf.withColumn("_hit", hit).select(*keys, side.alias("_s"), "_hit")
    t = rows.groupBy(*keys, F.col("_s.class").alias("class")).agg(
        F.sum("_s.truth").alias("support"), F.sum("_s.said").alias("predicted"),
        F.sum(F.when(F.col("_s.truth") > 0, F.col("_hit")).otherwise(0)).alias("tp"),
    )
    safe = lambda num, den: F.when(den > 0, num / den).otherwise(0.0)
    return t.select(
        *keys, "class",
        safe(F.col("tp"), F.col("predicted")).alias("precision"),
        safe(F.col("tp"), F.col("support")).alias("recall"),
        safe(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support", "predicted",
    )


def classification_metrics(predictions: DataFrame, keys=(), y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Long ``(keys, metric, value)``: accuracy, macro_f1, cohen_kappa, n_collapsed."""
    keys = list(keys)
    conf = confusion(predictions, keys, y_true, y_pred)
    classes = per_class_metrics(conf, keys, y_true, y_pred)
    total = F.sum("support")
    per_key = classes.groupBy(*keys).agg(
        (F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("support").cast("double") * F.col("predicted")) / (total.cast("double") * total)).alias("_pe"),
        F.count_if((F.col("recall") < COLLAPSED_RECALL) & (F.col("support") > 0)).cast("double").alias("n_collapsed"),
    )
    kappa = F.when(F.col("_pe") < 1, (F.col("accuracy") - F.col("_pe")) / (1 - F.col("_pe")))
    wide = per_key.withColumn("cohen_kappa", kappa)
    return wide.unpivot(keys, ["accuracy", "macro_f1", "cohen_kappa", "n_collapsed"], "metric", "value")


def collapsed_classes(classes: DataFrame) -> DataFrame:
    return classes.filter((F.col("recall") < COLLAPSED_RECALL) & (F.col("support") > 0))


def _metrics_of_counts(counts: np.ndarray) -> np.ndarray:
    """(B, K, K) confusion counts -> (B, 3) accuracy, macro F1, kappa; NaN under two true classes."""
    total = counts.sum(axis=(1, 2))
    truth, said = counts.sum(axis=2), counts.sum(axis=1)
    hit = np.einsum("bii->bi", counts)
    present = (truth + said) > 0
    f1 = np.divide(2.0 * hit, truth + said, out=np.zeros_like(hit, dtype=float), where=present)
    accuracy = hit.sum(axis=1) / total
    chance = (truth * said).sum(axis=1) / total**2
    with np.errstate(invalid="ignore", divide="ignore"):
        kappa = (accuracy - chance) / (1 - chance)
    out = np.column_stack([accuracy, f1.sum(axis=1) / present.sum(axis=1), kappa])
    out[(truth > 0).sum(axis=1) < 2] = np.nan
    return out


def bootstrap_ci(
    predictions: DataFrame, keys=(), n_bootstrap: int = 1000, seed: int = 42, chunk: int = 250, y_true="y_true", y_pred="y_pred"
) -> DataFrame:
    """``(keys, metric, value, ci_lower, ci_upper)`` with percentile intervals.

    Drawing n rows with replacement and counting them into the confusion table is a multinomial
    draw over the table's cells. So each replicate costs K x K numbers instead of n rows, whatever
    the size of the prediction table, and has exactly the same distribution.
    """
    keys = list(keys)
    conf = confusion(predictions, keys, y_true, y_pred)
    packed = conf.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(y_true).alias("t"), F.col(y_pred).alias("p"), "n"))).alias("cells")
    )
    n_chunks = -(-n_bootstrap // chunk)
    work = packed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    work = work.withColumn("draw_seed", F.abs(F.xxhash64(F.lit(seed), F.lit("bootstrap"), "chunk", *keys)))
    work = work.select(
        *keys, "chunk", "draw_seed", F.col("cells.t").alias("t"), F.col("cells.p").alias("p"), F.col("cells.n").alias("n")
    )
    types = dict(work.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "accuracy double, macro_f1 double, cohen_kappa double"])

    def draw(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                values = row._asdict()
                t, p, n = (np.asarray(values[c]) for c in ("t", "p", "n"))
                classes = np.unique(np.concatenate([t, p]))
                cells = np.searchsorted(classes, t) * len(classes) + np.searchsorted(classes, p)
                size = min(chunk, n_bootstrap - values["chunk"] * chunk)
                rng = np.random.default_rng(values["draw_seed"])
                draws = rng.multinomial(n.sum(), n / n.sum(), size=size)
                counts = np.zeros((size, len(classes) ** 2))
                counts[:, cells] = draws
                m = _metrics_of_counts(counts.reshape(size, len(classes), len(classes)))
                out = pd.DataFrame(m, columns=["accuracy", "macro_f1", "cohen_kappa"])
                for k in reversed(keys):
                    out.insert(0, k, values[k])
                yield out

    names = ["accuracy", "macro_f1", "cohen_kappa"]
    drawn = work.mapInPandas(draw, schema).unpivot(keys, names, "metric", "_v").filter(~F.isnan("_v"))
    bounds = drawn.groupBy(*keys, "metric").agg(  # n_bootstrap values per metric
        F.percentile("_v", 0.025).alias("ci_lower"), F.percentile("_v", 0.975).alias("ci_upper")
    )
    points = classification_metrics(predictions, keys, y_true, y_pred).filter(F.col("metric").isin(names))
    return points.join(bounds, [*keys, "metric"], "left")


def wilcoxon_p(differences: Column) -> Column:
    """Two-sided signed-rank p of an array of paired differences (one entry per seed).

    Exact up to 50 non-zero differences without ties, the normal approximation otherwise; NULL
    when every difference is zero.
    """
    differences = F.transform(differences, lambda d: F.round(d, 12))  # equal differences compare equal
    nonzero = F.filter(differences, lambda d: d != 0)
    sizes = F.transform(nonzero, lambda d: F.abs(d))
    rank = lambda d: (
        F.size(F.filter(sizes, lambda s: s < F.abs(d))) + (F.size(F.filter(sizes, lambda s: s == F.abs(d))) + 1) / F.lit(2.0)
    )
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    n = F.size(nonzero)
    plus = total(F.transform(F.filter(nonzero, lambda d: d > 0), rank))
    whole = n * (n + 1) / F.lit(2.0)
    low = F.least(plus, whole - plus)
    ties = total(
        F.transform(
            F.array_distinct(sizes),
            lambda s: F.pow(F.size(F.filter(sizes, lambda o: o == s)).cast("double"), F.lit(3.0))
            - F.size(F.filter(sizes, lambda o: o == s)),
        )
    )
    clean = (F.size(F.array_distinct(sizes)) == n) & (n == F.size(differences)) & (n <= 50)
    top = (n * (n + 1) / 2).cast("int")
    slots = F.sequence(F.lit(0), top)
    # number of rank subsets with each sum, built one rank at a time
    ways = F.aggregate(
        F.sequence(F.lit(1), n),
        F.transform(slots, lambda i: F.when(i == 0, 1.0).otherwise(0.0)),
        lambda acc, r: F.transform(
            slots, lambda i: F.get(acc, i) + F.coalesce(F.when(i >= r, F.get(acc, i - r)), F.lit(0.0))
        ),
    )
    exact = F.least(
        F.lit(1.0), 2 * total(F.slice(ways, F.lit(1), F.floor(low).cast("int") + 1)) / F.pow(F.lit(2.0), n.cast("double"))
    )
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)
    approx = normal_two_sided((plus - whole / 2) / spread)
    return F.when(n == 0, F.lit(None).cast("double")).when(clean, exact).otherwise(approx)


def seed_summary(metrics: DataFrame, base, mode="mode_id", seed="seed") -> DataFrame:
    """Per (metric, mode): mean, sample sd, paired delta to ``base`` and signed-rank p over seeds."""
    ref = metrics.filter(F.col(mode) == base).select("metric", seed, F.col("value").alias("_base"))
    paired = metrics.join(ref, ["metric", seed], "left")
    delta = F.col("value") - F.col("_base")
    diffs = F.transform(F.array_sort(F.collect_list(F.struct(seed, delta.alias("d")))), lambda s: s["d"])
    t = paired.groupBy("metric", mode).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.avg(delta).alias("delta_vs_base"),
        F.count_distinct(seed).alias("n_seeds"), diffs.alias("_d"),
    )
    p = F.when(F.col(mode) != base, wilcoxon_p(F.col("_d")))
    return t.withColumn("wilcoxon_p", p).drop("_d")


def per_class_summary(classes: DataFrame, mode="mode_id", seed="seed") -> DataFrame:
    return classes.groupBy(mode, "class").agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.avg("support").alias("support"), F.count_distinct(seed).alias("n_seeds"),
    )


def training_curve(epochs: DataFrame, mode="mode") -> DataFrame:
    """Mean curve per (mode, epoch)."""
    return epochs.groupBy(mode, "epoch").agg(
        F.avg("loss").alias("loss"), F.avg("acc").alias("acc"), F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("n")
    )


def params_vs_f1(metrics: DataFrame, params: DataFrame, mode="mode_id") -> DataFrame:
    f1 = metrics.filter(F.col("metric") == "macro_f1").groupBy(mode).agg(F.avg("value").alias("macro_f1"))
    return f1.join(params, mode)


def expected_runs(results: DataFrame, seeds: list, modes: list, seed="seed", mode="mode") -> DataFrame:
    """(seed, mode) combinations without a result, as a set difference."""
    spark = results.sparkSession
    wanted = spark.createDataFrame([(s, m) for s in seeds for m in modes], f"{seed} long, {mode} string")
    return wanted.exceptAll(results.select(F.col(seed).cast("long").alias(seed), mode).distinct())


def salvage_summary(results: DataFrame, base: str = "none", seed="seed", mode="mode", value="macro_f1") -> DataFrame:
    """Per mode: runs, mean, sd, extremes, and wins / mean / median delta to ``base`` on shared seeds.

    ``results`` holds one row per (run, seed, mode); repeated rows of a seed are averaged first.
    """
    runs = results.groupBy(seed, mode).agg(F.avg(value).alias("v"))
    ref = runs.filter(F.col(mode) == base).select(seed, F.col("v").alias("_b"))
    t = runs.join(ref, seed, "left")
    d = F.col("v") - F.col("_b")
    return t.groupBy(mode).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"),
        F.max("v").alias("max"), F.count_if(d > 0).alias("wins"), F.avg(d).alias("mean_delta"),
        F.percentile(d, 0.5).alias("median_delta"),  # one value per seed
    )
