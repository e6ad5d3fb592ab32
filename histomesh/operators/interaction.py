"""Habitat-pair adjacency and its permutation scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomesh.operators.order import row_positions
from histomesh.operators.permutation import TILE_POINTS, frames, permuted_pair_sums, shuffled_codes, toroidal_rows
from histomesh.operators.spatial import radius_pairs
from histomesh.session import durable

MIN_PATCHES = 20


def unit_offsets(permutations: int = 1000, seed: int = 42) -> list[tuple[float, float]]:
    return [tuple(p) for p in np.random.default_rng(seed).random((permutations, 2)).tolist()]


def _both_ways(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Undirected counts in both orientations; a pair of equal habitats counts twice."""
    ends = F.explode(
        F.array(
            F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")),
            F.struct(F.col("hi").alias("a"), F.col("lo").alias("b")),
        )
    )
    return (
        counts.select(*keys, ends.alias("_e"), "n")
        .groupBy(*keys, F.col("_e.a").alias("a"), F.col("_e.b").alias("b"))
        .agg(F.sum("n").alias("n"))
    )


def _frequencies(counts: DataFrame, keys: list[str]) -> DataFrame:
    both = _both_ways(counts, keys)
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))  # at most n_habitats^2 rows
    return both.withColumn("freq", share)


def adjacency_matrix(patches: DataFrame, keys=("sample_id",), radius: float = 100.0) -> DataFrame:
    """``(keys, a, b, n, freq)``: share of neighbouring patch pairs by habitat pair."""
    keys = list(keys)
    pairs = radius_pairs(patches, keys, "patch_id", radius, carry=("habitat",), unordered=True)
    counts = pairs.groupBy(
        *keys, F.col("habitat").alias("lo"), F.col("nbr_habitat").alias("hi")
    ).agg(F.count(F.lit(1)).alias("n"))
    return _frequencies(counts, keys)


def _unrolled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, patch_id, perm, label)`` of the packed rows of ``toroidal_rows``."""

    def run(batches):
        for batch in batches:
            perms, labels = batch.column("perms"), batch.column("labels")
            perm, label = batch.column("perm").to_pylist(), batch.column("label").to_pylist()
            each = []
            for r in range(batch.num_rows):
                if not labels[r].is_valid:
                    each.append((np.array([perm[r]]), np.array([label[r]])))
                    continue
                own = np.frombuffer(labels[r].as_py(), np.uint8)
                each.append((np.frombuffer(perms[r].as_py(), np.int32) if perms[r].is_valid else np.arange(len(own)), own))
            take = pa.array(np.repeat(np.arange(len(each)), [len(p) for p, _ in each]).astype(np.int64))
            perm, label = (np.concatenate([np.zeros(0, np.int32), *c]) for c in (zip(*each) if each else ([], [])))
            kept = [batch.column(k).take(take) for k in (*keys, "patch_id")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(perm, pa.int32()), pa.array(label, pa.int32())], [*keys, "patch_id", "perm", "label"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in (*keys, "patch_id")) + ", perm int, label int")


def toroidal_labels(patches: DataFrame, keys: list[str], offsets, n_habitats: int = 10, tile_points: int = TILE_POINTS) -> DataFrame:
    """``(keys, patch_id, perm, label)``: habitat of the patch nearest to each shifted position."""
    return _unrolled(toroidal_rows(patches, list(keys), offsets, n_habitats, tile_points), list(keys))


def shuffled_labels(patches: DataFrame, keys: list[str], permutations: int, seed: int = 42, n_habitats: int = 10) -> DataFrame:
    """``(keys, patch_id, perm, label)``: the labels of each sample dealt out at random, once per permutation."""
    keys = list(keys)
    placed = row_positions(patches.select(*keys, "patch_id"), keys, ["patch_id"], "_position")
    rows = placed.join(frames(patches, keys, n_habitats, TILE_POINTS).select(*keys, "_n", "_salt", "_counts"), keys)
    none = {"perms": F.lit(None).cast("binary"), "perm": F.lit(None).cast("int"), "label": F.lit(None).cast("int")}

    def run(batches):
        for batch in batches:
            labels = []
            for position, n, salt, counts in zip(*(batch.column(c).to_pylist() for c in ("_position", "_n", "_salt", "_counts"))):
                labels.append(shuffled_codes(np.array([position]), n, np.array(counts), permutations, seed, salt)[0].tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keys, "patch_id")), pa.array(labels, pa.binary())], [*keys, "patch_id", "labels"])

    kinds = dict(patches.dtypes)
    packed = rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in (*keys, "patch_id")) + ", labels binary")
    return _unrolled(packed.withColumns(none), keys)


def interaction_z(
    patches: DataFrame, keys=("sample_id",), n_habitats: int = 10, radius: float = 100.0, offsets=None,
    null_model: str = "toroidal", permutations: int = 1000, seed: int = 42, tile_points: int = TILE_POINTS,
) -> DataFrame:
    """``(keys, a, b, z)`` for all ordered habitat pairs of samples with >= 20 patches and any pair.

    A pair's frequency is its count over that of all neighbouring pairs in both orientations, which no
    permutation changes; mean and deviation come from whole counts and their squares, so they are
    exact. z is 0 where the permutations do not vary.
    """
    keys = list(keys)
    if null_model not in ("toroidal", "shuffle"):
        raise ValueError(f"unknown null model {null_model!r}")
    if null_model == "toroidal":
        offsets = offsets if offsets is not None else unit_offsets(permutations, seed)
    n_perm = len(offsets) if null_model == "toroidal" else permutations
    big = patches.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= MIN_PATCHES)
    points = durable(patches.select(*keys, "patch_id", "x_um", "y_um", "habitat").join(big, keys))
    counts = durable(
        permuted_pair_sums(points, keys, n_habitats, radius, offsets if null_model == "toroidal" else None, n_perm, seed, tile_points)
    )
    whole = counts.groupBy(*keys).agg(F.sum("obs").alias("_total")).filter(F.col("_total") > 0)
    sums = counts.filter(F.col("b") < n_habitats).select(*keys, "a", "b", F.col("obs").alias("_obs"), F.col("s").alias("_s"), F.col("ss").alias("_ss"))
    twice = F.when(F.col("a") == F.col("b"), F.lit(2.0)).otherwise(F.lit(1.0)) / (2 * F.col("_total"))
    spread = F.sqrt((n_perm * F.col("_ss") - F.col("_s") * F.col("_s")).cast("double")) / n_perm
    scored = sums.join(whole, keys).select(
        *keys, "a", "b", (F.col("_obs") * twice).alias("observed"), (F.col("_s").cast("double") / n_perm * twice).alias("null_mean"), (spread * twice).alias("null_sd")
    )
    both = scored.unionByName(scored.filter("a < b").select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "observed", "null_mean", "null_sd"))
    habitats = F.lit(list(range(n_habitats)))
    scaffold = whole.select(*keys).withColumn("a", F.explode(habitats)).withColumn("b", F.explode(habitats))
    full = scaffold.join(both, [*keys, "a", "b"], "left")
    z = F.when(F.col("null_sd") > 1e-9, (F.col("observed") - F.col("null_mean")) / F.col("null_sd")).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return full.select(*keys, "a", "b", zero("observed"), zero("null_mean"), zero("null_sd"), z.alias("z"))


def significant(z: Column, limit: float = 1.96) -> Column:
    return F.abs(z) > limit


def null_model_comparison(patches: DataFrame, keys=("sample_id",), **kw) -> DataFrame:
    """Habitat pairs beyond |z| > 1.96 under each null, per sample."""
    keys = list(keys)
    parts = []
    for model in ("toroidal", "shuffle"):
        scores = interaction_z(patches, keys, null_model=model, **{k: v for k, v in kw.items() if k != "offsets" or model == "toroidal"})
        parts.append(
            scores.groupBy(*keys).agg(
                F.count_if(significant(F.col("z"))).alias("n_significant"), F.count(F.lit(1)).alias("n_pairs")
            ).withColumn("null_model", F.lit(model))
        )
    return parts[0].unionByName(parts[1])
