"""Per-sample habitat features: composition, diversity, distances, transitions, and the full table.

Feature blocks are long tables ``(keys, feature, value)``; ``keys`` is ``["sample_id"]`` or
``["sample_id", "compartment"]``. Undefined values are NULL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomesh.operators import pointpattern as pp
from histomesh.operators.groups import DIRECT, ENTRIES, WHOLE, by_whole_groups, codes, column, nearest_squared, squares
from histomesh.operators.interaction import interaction_z
from histomesh.operators.spatial import knn_join, nearest_distance
from histomesh.session import durable

N_HABITATS = 10
IN_PAIRS = 2048  # patches of a sample that meet one by one


def tag(i: Column | int) -> Column:
    i = i if isinstance(i, Column) else F.lit(i)
    return F.format_string("H%02d", i + 1)


def background_report(patches: DataFrame, n_habitats: int = N_HABITATS) -> DataFrame:
    """One row: patches in total and patches outside 0..n_habitats-1."""
    bad = ~F.col("habitat").between(0, n_habitats - 1) | F.col("habitat").isNull()
    return patches.agg(F.count(F.lit(1)).alias("n_patches"), F.count_if(bad).alias("n_outside"))


def assert_no_background(patches: DataFrame, n_habitats: int = N_HABITATS) -> DataFrame:
    bad = background_report(patches, n_habitats).first()["n_outside"]
    if bad:
        raise ValueError(f"{bad} patches lie outside habitats 0..{n_habitats - 1}; drop the background class")
    return patches


def habitat_counts(patches: DataFrame, keys=("sample_id",)) -> DataFrame:
    return patches.groupBy(*keys, "habitat").agg(F.count(F.lit(1)).alias("n"))


def composition_features(patches: DataFrame, keys=("sample_id",), n_habitats: int = N_HABITATS) -> DataFrame:
    """Share of each habitat, all habitats present as rows."""
    total = F.count(F.lit(1))
    wide = patches.groupBy(*keys).agg(
        *[(F.count_if(F.col("habitat") == h) / total).alias(f"comp_H{h + 1:02d}") for h in range(n_habitats)]
    )
    return wide.unpivot(list(keys), [f"comp_H{h + 1:02d}" for h in range(n_habitats)], "feature", "value")


def fisher_alpha(n: Column, s: Column, tol: float = 1e-8, rounds: int = 200) -> Column:
    """alpha solving S = alpha ln(1 + N/alpha), by bisection on [1e-6, 1e6]; NULL when undefined."""
    n, s = n.cast("double"), s.cast("double")

    def step(state, _):
        mid = (state["lo"] + state["hi"]) / 2
        value = mid * F.log1p(n / mid)
        done = state["hit"].isNotNull()
        low = value < s
        return F.struct(
            F.when(done | ~low, state["lo"]).otherwise(mid).alias("lo"),
            F.when(done | low, state["hi"]).otherwise(mid).alias("hi"),
            F.when(done, state["hit"]).when(F.abs(value - s) < tol, mid).alias("hit"),
        )

    start = F.struct(F.lit(1e-6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(None).cast("double").alias("hit"))
    solved = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda a: F.coalesce(a["hit"], (a["lo"] + a["hi"]) / 2)
    )
    return F.when((s > 1) & (n > s), solved)


def diversity_table(patches: DataFrame, keys=("sample_id",)) -> DataFrame:
    counts = habitat_counts(patches, keys)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    base = (
        counts.join(totals, list(keys))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).cast("double").alias("div_richness"),
            (-F.sum(p * F.log(p))).alias("div_shannon"),
            (1 - F.sum(p * p)).alias("div_simpson"),
            (1 / F.sum(p * p)).alias("div_inv_simpson"),
            F.max("total").alias("total"),
        )
    )
    return base.withColumns(
        {
            "div_fisher_alpha": fisher_alpha(F.col("total"), F.col("div_richness")),
            "div_pielou": F.when(F.col("div_richness") > 1, F.col("div_shannon") / F.log("div_richness")).otherwise(0.0),
        }
    )


DIVERSITY = ["div_richness", "div_shannon", "div_simpson", "div_inv_simpson", "div_fisher_alpha", "div_pielou"]


def diversity_features(patches: DataFrame, keys=("sample_id",)) -> DataFrame:
    return diversity_table(patches, keys).unpivot(list(keys), DIVERSITY, "feature", "value")


def pair_distances(patches: DataFrame, keys=("sample_id",), n_habitats: int = N_HABITATS) -> DataFrame:
    """Mean distance from habitat ``source`` to the nearest patch of ``target``, source <= target.

    The distance runs from source to target only. NULL-valued pairs (target under two patches or
    source absent) are left out. Samples of ``WHOLE`` patches at most are measured in the task that has them.
    """
    keys = list(keys)
    few, patches = _by_size(patches, keys, WHOLE)
    near = _pair_distances_in_tasks(few, keys)
    if patches is not None:
        near = near.unionByName(_pair_distances_in_rounds(patches, keys))
    return near


def _by_size(patches: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Patches of samples of ``most`` at most, and a stored table of the others, if there are any."""
    large = durable(patches.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*keys))
    if large.isEmpty():
        return patches, None
    return patches.join(large, keys, "left_anti"), durable(patches.join(large, keys, "left_semi"))


def _pair_distances_in_tasks(patches: DataFrame, keys: list[str]) -> DataFrame:
    def measure(table: pa.Table, starts: np.ndarray) -> pa.Table | None:
        habitat, x, y, ids = column(table, "habitat"), column(table, "x_um"), column(table, "y_um"), codes(table, "patch_id")
        known = np.isfinite(x) & np.isfinite(y) & (ids >= 0)
        lead, out = [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            kinds, size = np.unique(habitat[a:b], return_counts=True)
            at = a + np.flatnonzero(known[a:b])
            own, px, py, pid = habitat[at], x[at], y[at], ids[at]
            first = np.searchsorted(own, kinds)  # rows come by habitat
            held = np.flatnonzero((np.diff(np.r_[first, len(own)]) > 0) & (size >= 2))
            if not len(held):
                continue
            near = np.full((len(own), len(held)), np.inf)
            if len(own) <= 2 * DIRECT:
                present = np.flatnonzero(np.diff(np.r_[first, len(own)]) > 0)
                step = max(1, ENTRIES // len(own))
                for i in range(0, len(own), step):
                    near[i : i + step] = np.minimum.reduceat(squares(px, py, pid, i, i + step), first[present], 1)[:, np.isin(present, held)]
            else:
                ends = np.r_[first, len(own)]
                for j, t in enumerate(held.tolist()):
                    right, left = slice(ends[t], ends[t + 1]), slice(0, ends[t + 1])
                    near[left, j] = nearest_squared(px[right], py[right], px[left], py[left], pid[right], pid[left])
            hit = np.isfinite(near) & (own[:, None] <= kinds[held])
            total = np.stack([np.bincount(np.searchsorted(kinds, own), np.where(hit[:, j], np.sqrt(near[:, j]), 0.0), len(kinds)) for j in range(len(held))], 1)
            count = np.stack([np.bincount(np.searchsorted(kinds, own), hit[:, j], len(kinds)) for j in range(len(held))], 1)
            s, t = np.nonzero(count)
            out.append(np.stack([kinds[s], kinds[held][t]]))
            lead.append((np.full(len(s), a), total[s, t] / count[s, t]))
        if not out:
            return None
        take, mean = (np.concatenate(c) for c in zip(*lead))
        pair = np.concatenate(out, 1)
        kept = [table.column(k).take(pa.array(take)).combine_chunks() for k in keys]
        kind = table.schema.field("habitat").type
        return pa.Table.from_arrays([*kept, pa.array(pair[0]).cast(kind), pa.array(pair[1]).cast(kind), pa.array(mean)], [*keys, "source", "target", "mean_dist"])

    kinds = dict(patches.dtypes)
    rows = patches.select(*keys, "patch_id", "x_um", "y_um", "habitat").dropna(subset=[*keys, "habitat"])
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", source {kinds['habitat']}, target {kinds['habitat']}, mean_dist double"
    return by_whole_groups(rows, keys, ["habitat"], measure, schema)


def _pair_distances_in_rounds(patches: DataFrame, keys: list[str]) -> DataFrame:
    counts = habitat_counts(patches, keys)
    targets = (
        counts.filter(F.col("n") >= 2)
        .groupBy(*keys)
        .agg(F.collect_set("habitat").alias("_targets"))  # at most n_habitats entries
    )
    sources = patches.select(*keys, "patch_id", "x_um", "y_um", F.col("habitat").alias("source")).join(targets, keys)
    sources = (
        sources.withColumn("target", F.explode("_targets")).drop("_targets").filter(F.col("source") <= F.col("target"))
    )
    sources = durable(sources)
    right = patches.select(
        *keys, F.col("habitat").alias("target"), F.col("patch_id").alias("nbr_id"),
        F.col("x_um").alias("nx"), F.col("y_um").alias("ny"),
    )
    near = nearest_distance(
        sources, right, [*keys, "target"], "patch_id", "nbr_id", ("x_um", "y_um"), ("nx", "ny"), exclude_self=True
    )
    return near.groupBy(*keys, "source", "target").agg(F.avg("nn_dist").alias("mean_dist"))


def distance_features(patches: DataFrame, keys=("sample_id",), n_habitats: int = N_HABITATS) -> DataFrame:
    means = pair_distances(patches, keys, n_habitats)
    name = F.concat(F.lit("dist_"), tag(F.col("source")), F.lit("_"), tag(F.col("target")))
    return means.select(*keys, name.alias("feature"), F.col("mean_dist").alias("value"))


def transition_entropy(patches: DataFrame, keys=("sample_id",), k: int = 6) -> DataFrame:
    """Entropy of habitat transitions along k-nearest-neighbour links; samples with n <= k drop out."""
    keys = list(keys)
    enough = patches.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > k).drop("_n")
    points = patches.select(*keys, "patch_id", "x_um", "y_um", "habitat").join(enough, keys, "left_semi")
    few, points = _by_size(durable(points), keys, IN_PAIRS)
    counts = _links_in_tasks(few, keys, k)
    if points is not None:
        right = points.select(
            *keys, F.col("patch_id").alias("nbr_id"), F.col("x_um").alias("nx"), F.col("y_um").alias("ny"),
            F.col("habitat").alias("nbr_habitat"),
        )
        links = knn_join(points, right, keys, k, "patch_id", "nbr_id", ("x_um", "y_um"), ("nx", "ny"), exclude_self=True)
        counts = counts.unionByName(links.groupBy(*keys, "habitat", "nbr_habitat").agg(F.count(F.lit(1)).alias("n")))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))  # at most n_habitats^2 rows
    return (
        counts.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log("p"))).alias("transition_ste"))
    )


def _links_in_tasks(points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, habitat, nbr_habitat, n) of the links to the ``k`` nearest patches; of equal distances the smaller id holds."""

    def count(table: pa.Table, starts: np.ndarray) -> pa.Table | None:
        x, y, ids, habitat = column(table, "x_um"), column(table, "y_um"), codes(table, "patch_id"), codes(table, "habitat")
        known = np.isfinite(x) & np.isfinite(y) & (ids >= 0)
        width, lead, out = int(habitat.max()) + 2, [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            at = a + np.flatnonzero(known[a:b])
            need = min(k, len(at) - 1)
            if need < 1:
                continue
            px, py, pid, own, links = x[at], y[at], ids[at], habitat[at] + 1, np.zeros(width * width, np.int64)
            step = max(1, ENTRIES // len(at))
            for i in range(0, len(at), step):
                d = squares(px, py, pid, i, i + step)
                edge = np.partition(d, need - 1, 1)[:, need - 1 : need]
                chosen = (d <= edge) & np.isfinite(d)
                for r in np.flatnonzero(chosen.sum(1) > need).tolist():
                    chosen[r] = False
                    chosen[r, np.argsort(d[r], kind="stable")[:need]] = True  # rows come by id
                row, near = np.nonzero(chosen)
                links += np.bincount(own[i + row] * width + own[near], minlength=width * width)
            some = np.flatnonzero(links)
            kind = {c: p for c, p in zip(own.tolist(), at.tolist())}  # a row that has the habitat
            out.append(np.stack([np.full(len(some), a), [kind[c] for c in (some // width).tolist()], [kind[c] for c in (some % width).tolist()], links[some]]))
        if not out:
            return None
        take, one, two, n = np.concatenate(out, 1).astype(np.int64)
        pick = lambda name, rows: table.column(name).take(pa.array(rows)).combine_chunks()
        return pa.Table.from_arrays([*(pick(c, take) for c in keys), pick("habitat", one), pick("habitat", two), pa.array(n)], [*keys, "habitat", "nbr_habitat", "n"])

    kinds = dict(points.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", habitat {kinds['habitat']}, nbr_habitat {kinds['habitat']}, n bigint"
    return by_whole_groups(points, keys, ["patch_id"], count, schema)


def transition_features(patches: DataFrame, keys=("sample_id",), k: int = 6) -> DataFrame:
    return transition_entropy(patches, keys, k).unpivot(list(keys), ["transition_ste"], "feature", "value")


def feature_names(n_habitats: int = N_HABITATS) -> list[str]:
    """The stable column order of the feature table (262 names for ten habitats)."""
    tags = [f"H{h + 1:02d}" for h in range(n_habitats)]
    return (
        [f"comp_{t}" for t in tags]
        + DIVERSITY
        + [f"disp_{t}_{m}" for t in tags for m in pp.METRICS]
        + [f"inter_{a}_{b}" for a in tags for b in tags]
        + [f"dist_{a}_{b}" for i, a in enumerate(tags) for b in tags[i:]]
        + ["transition_ste"]
    )


def extract_all_features(
    patches: DataFrame, keys=("sample_id",), n_habitats: int = N_HABITATS, probes=None, offsets=None,
    null_model: str = "toroidal", permutations: int = 1000,
) -> DataFrame:
    """One row per key with every feature column in stable order."""
    keys = list(keys)
    assert_no_background(patches, n_habitats)
    patches = durable(patches.select(*keys, "patch_id", "x_um", "y_um", "habitat"))  # read by every block
    blocks = [
        composition_features(patches, keys, n_habitats),
        diversity_features(patches, keys),
        pp.dispersion_features(patches, keys, probes=probes),
        interaction_z(patches, keys, n_habitats, offsets=offsets, null_model=null_model, permutations=permutations)
        .select(
            *keys,
            F.concat(F.lit("inter_"), tag(F.col("a")), F.lit("_"), tag(F.col("b"))).alias("feature"),
            F.col("z").alias("value"),
        ),
        distance_features(patches, keys, n_habitats),
        transition_features(patches, keys),
    ]
    long = blocks[0]
    for block in blocks[1:]:
        long = long.unionByName(block)
    names = feature_names(n_habitats)
    wide = long.groupBy(*keys).pivot("feature", names).agg(F.first("value"))
    if len(wide.columns) - len(keys) != len(names):
        raise AssertionError(f"{len(wide.columns) - len(keys)} features, expected {len(names)}")
    return wide
