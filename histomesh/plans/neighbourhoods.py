"""From a cell table to neighbourhood classes, and on to labelled patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.operators import cells as C
from histomesh.operators import cluster as U
from histomesh.operators import composition as K
from histomesh.operators import labels as L
from histomesh.session import durable


def discover(
    cells: DataFrame, vocabulary: list | None = None, radius: float = 40.0, min_cells: int = 200, n_topics: int = 8, k: int = 10,
    n_init: int = 25, sweep: tuple[int, int] | None = None, type_col="cell_type", seed: int = 42, **validation,
) -> dict[str, DataFrame]:
    """Validated cells -> compositions -> topics -> classes -> enrichment.

    Returns ``matrix, size_qc, topics, assignments, enrichment, definitions`` and, with ``sweep``,
    the table of k-selection metrics.
    """
    C.validate_cells(cells, ("image_id", "cell_id", "x_um", "y_um", type_col), **validation)
    kept = C.min_cells_filter(cells, min_cells)
    if kept.isEmpty():
        raise ValueError(f"no image has {min_cells} cells")
    if vocabulary is None:
        vocabulary = [r[type_col] for r in C.vocabulary_of(kept, type_col).orderBy("type_index").collect()]  # type names
    else:
        C.check_vocabulary(kept, vocabulary, type_col)
    matrix = durable(K.composition_matrix(kept, vocabulary, radius, type_col=type_col))
    columns = [f"n_{t}" for t in vocabulary]
    topics = durable(U.fit_topics(matrix, columns, ["image_id", "cell_id"], n_topics, seed=seed))
    assigned = durable(U.assign_cns(topics, k, n_init, seed=seed))
    labelled = matrix.join(assigned.select("image_id", "cell_id", "cn_label"), ["image_id", "cell_id"])
    enrichment = K.cn_enrichment(labelled, "cn_label", columns)
    out = {
        "matrix": matrix, "size_qc": K.neighbourhood_size_qc(matrix, columns), "topics": topics, "assignments": assigned,
        "enrichment": enrichment, "definitions": K.cn_definitions(enrichment, assigned, "cn_label"),
    }
    if sweep:
        out["sweep"] = U.sweep_k(topics, *sweep, seed=seed)
    return out


def cohort_patches(cells: DataFrame, assignments: DataFrame, mpp: float, patch_px: int, max_patches: int, n_habitats: int = 10) -> DataFrame:
    """Labelled patches of every specimen, capped to a contiguous block per specimen."""
    labelled = cells.join(assignments.select("image_id", "cell_id", "cn"), ["image_id", "cell_id"]).select(
        F.col("image_id").alias("sample_id"), (F.col("x_um") / mpp).alias("x_px"), (F.col("y_um") / mpp).alias("y_px"), "cn"
    )
    patches = durable(L.label_patches(labelled, patch_px, n_habitats))
    capped = L.contiguous_cap(patches, max_patches)
    return capped.withColumns({"x_px": F.col("patch_x") * patch_px, "y_px": F.col("patch_y") * patch_px, "patch_px_native": F.lit(patch_px)})


def paired_patches(
    nuclei: DataFrame, cells: DataFrame, affine, mpp: float, patch_px: int, sizes: dict[str, int] | None = None, max_um: float = 5.0, seed: int = 42
) -> dict[str, DataFrame]:
    """Labels carried onto nuclei, patch labels, a sample-level split and the report."""
    moved = durable(L.transfer_labels(nuclei, cells, affine, mpp, max_um))
    patches = durable(L.label_patches(moved, patch_px))
    out = {"nuclei": moved, "matched": L.matched_fraction(moved), "patches": patches}
    by = ["label"]
    if sizes:
        split = durable(L.sample_split(moved, "sample_id", sizes, seed=seed))
        out["patches"] = patches = durable(patches.join(split, "sample_id"))
        by = ["split", "label"]
    out["report"] = L.patch_label_report(patches, by)
    return out
