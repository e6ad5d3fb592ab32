"""Cell-table preparation: units, artefacts, validation, vocabularies and marker gating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.operators.order import row_positions


def scale_coords(df: DataFrame, mpp: float, xy_px=("x_px", "y_px"), xy_um=("x_um", "y_um")) -> DataFrame:
    """Pixels to microns."""
    return df.withColumns({um: F.col(px) * F.lit(mpp) for px, um in zip(xy_px, xy_um)})


def native_patch_px(mpp: Column, patch_px: int = 224, target_mpp: float = 0.5) -> Column:
    """Side of a patch in native pixels, rounded half to even."""
    return F.bround(F.lit(patch_px * target_mpp) / mpp).cast("int")


def drop_artefacts(df: DataFrame, order: list[str], type_col="cell_type", artefacts=("dirt",)) -> DataFrame:
    """Drop artefact types and number the remaining cells 0.. in ``order`` as ``cell_id``."""
    kept = df.filter(~F.col(type_col).isin(*artefacts))
    return row_positions(kept, [], order, "cell_id")


def validation_report(
    cells: DataFrame, image="image_id", cell="cell_id", xy=("x_um", "y_um"), max_span=20000.0, min_span=50.0
) -> DataFrame:
    """One row: counts, duplicate keys, span over the whole table, and a verdict."""
    x, y = xy
    # one pass by key gives duplicates; extents ride along so the table is read once
    per_key = cells.groupBy(image, cell).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"),
    )
    per_image = per_key.groupBy(image).agg(
        F.sum("n").alias("n_cells"),
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("dup"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"),
    )
    span = F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0"))
    row = per_image.agg(
        F.sum("n_cells").alias("n_cells"),
        F.count(F.lit(1)).alias("n_images"),
        F.sum("dup").alias("n_duplicate_keys"),
        span.alias("span_um"),
    )
    verdict = (
        F.when(F.col("n_duplicate_keys") > 0, "duplicate cells")
        .when(F.col("span_um") > max_span, "coordinates look like pixels")
        .when(F.col("span_um") < min_span, "coordinates span too little")
        .otherwise("ok")
    )
    return row.withColumn("verdict", verdict)


def validate_cells(cells: DataFrame, required=("image_id", "cell_id", "x_um", "y_um", "cell_type"), **kw) -> DataFrame:
    """Return ``cells`` or raise ``ValueError`` naming what is wrong."""
    missing = [c for c in required if c not in cells.columns]
    if missing:
        raise ValueError(f"cell table missing columns {missing}")
    verdict = validation_report(cells, **kw).first()["verdict"]
    if verdict != "ok":
        raise ValueError(verdict)
    return cells


def min_cells_filter(cells: DataFrame, min_cells: int = 200, image="image_id") -> DataFrame:
    """Keep images holding at least ``min_cells`` cells (semi join on one row per image)."""
    enough = cells.groupBy(image).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_cells)
    return cells.join(enough.select(image), image, "left_semi")


def unknown_types(cells: DataFrame, vocabulary: list[str], type_col="cell_type") -> DataFrame:
    """Types outside the vocabulary, with counts; empty when the table is clean."""
    counts = cells.groupBy(type_col).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(~F.col(type_col).isin(list(vocabulary)) | F.col(type_col).isNull())


def vocabulary_of(cells: DataFrame, type_col="cell_type") -> DataFrame:
    """Sorted distinct types with their 0-based index."""
    return row_positions(cells.select(type_col).distinct(), [], [type_col], "type_index")


def check_vocabulary(cells: DataFrame, vocabulary: list[str], type_col="cell_type") -> DataFrame:
    bad = unknown_types(cells, vocabulary, type_col).limit(20).collect()
    if bad:
        raise ValueError(f"cell types outside the vocabulary: {[r[type_col] for r in bad]}")
    return cells


# The shared lineage vocabulary and the phenotype names it collapses.
LINEAGES = ["tumour", "t_cell", "b_cell", "macrophage", "vascular", "stroma_sma", "other_immune", "other"]
PHENOTYPES_BY_LINEAGE = {
    "tumour": ["tumor cells", "tumor cells / immune cells"],
    "t_cell": ["CD4+ T cells", "CD4+ T cells CD45RO+", "CD4+ T cells GATA3+", "CD8+ T cells", "CD3+ T cells", "Tregs"],
    "b_cell": ["B cells"],
    "macrophage": [
        "CD68+ macrophages", "CD163+ macrophages", "CD68+CD163+ macrophages", "CD11b+CD68+ macrophages",
        "CD68+ macrophages GzmB+",
    ],
    "vascular": ["vasculature", "lymphatics", "immune cells / vasculature"],
    "stroma_sma": ["smooth muscle", "stroma"],
    "other_immune": ["granulocytes", "plasma cells", "immune cells", "NK cells", "CD11c+ DCs", "CD11b+ monocytes"],
    "other": ["adipocytes", "nerves", "undefined"],
}


def map_lineage(cells: DataFrame, mapping: dict[str, list[str]] | None = None, type_col="cell_type") -> DataFrame:
    """Add ``lineage`` (names outside the mapping become 'other') and ``mapped``."""
    mapping = mapping or PHENOTYPES_BY_LINEAGE
    lineage = None
    for name, members in mapping.items():
        hit = F.col(type_col).isin(members)
        lineage = F.when(hit, name) if lineage is None else lineage.when(hit, name)
    return cells.withColumn("_l", lineage).select(
        *cells.columns, F.coalesce("_l", F.lit("other")).alias("lineage"), F.col("_l").isNotNull().alias("mapped")
    )


def unmapped_report(cells: DataFrame, mapping=None, type_col="cell_type") -> DataFrame:
    return (
        map_lineage(cells, mapping, type_col)
        .filter(~F.col("mapped"))
        .groupBy(type_col)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def otsu_thresholds(
    df: DataFrame, value_columns: list[str], keys: list[str] = (), log: bool = True
) -> DataFrame:
    """Otsu threshold of each column (per ``keys``), long form ``(keys, marker, bin, threshold)``.

    Intensities are put on a log scale (``log=True``) and cut into 256 levels between the extremes;
    the level with the largest between-class variance is mapped back. Everything after the
    256-level histogram is small, whatever the number of cells.
    """
    keys = list(keys)
    long = df.select(*keys, *value_columns).unpivot(keys, value_columns, "marker", "_x")
    value = F.log1p(F.greatest(F.col("_x"), F.lit(0.0))) if log else F.col("_x").cast("double")
    long = long.select(*keys, "marker", value.alias("_v"))
    group = [*keys, "marker"]
    extent = long.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    level = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9) * 255).cast("int")
    hist = (
        long.join(extent if keys else F.broadcast(extent), group)  # without keys one row per marker: the values stay where they are
        .groupBy(*group, "_lo", "_hi", level.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = otsu_level(hist, group, carry=["_lo", "_hi"])
    back = F.col("bin") / 255.0 * (F.col("_hi") - F.col("_lo")) + F.col("_lo")
    return best.select(*group, "bin", (F.expm1(back) if log else back).alias("threshold"))


def otsu_level(hist: DataFrame, group: list[str], carry: list[str] = ()) -> DataFrame:
    """Level ``bin`` maximising between-class variance of a histogram ``(group, bin, n)``."""
    from pyspark.sql import Window

    upto = Window.partitionBy(*group).orderBy("bin")  # at most 256 rows per group
    whole = Window.partitionBy(*group)
    h = (
        hist.withColumn("w0", F.sum("n").over(upto))
        .withColumn("m0", F.sum(F.col("n") * F.col("bin")).over(upto))
        .withColumn("w", F.sum("n").over(whole))
        .withColumn("m", F.sum(F.col("n") * F.col("bin")).over(whole))
    )
    w1 = F.col("w") - F.col("w0")
    gap = F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / w1
    between = F.when(w1 > 0, F.col("w0").cast("double") * w1 * gap * gap).otherwise(F.lit(0.0))
    # the smallest level wins a tie: larger variance first, then smaller bin
    pick = F.max(F.struct(between.alias("v"), (-F.col("bin")).alias("b")))
    return (
        h.groupBy(*group, *carry).agg(pick.alias("_p")).select(*group, *carry, (-F.col("_p.b")).alias("bin"))
    )


def gate_lineages(markers: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Hierarchical gate into the lineage vocabulary; ``thresholds`` by marker column name."""
    on = {m: F.col(m) >= F.lit(float(t)) for m, t in thresholds.items()}
    leukocyte = on["cd45"]
    lineage = (
        F.when(on["panck"] | on["ecad"], "tumour")
        .when(leukocyte & on["cd3e"], "t_cell")
        .when(leukocyte & on["cd20"], "b_cell")
        .when(leukocyte & (on["cd68"] | on["cd163"]), "macrophage")
        .when(~leukocyte & on["cd31"], "vascular")
        .when(~leukocyte & on["sma"], "stroma_sma")
        .when(leukocyte, "other_immune")
        .otherwise("other")
    )
    return markers.withColumn("lineage", lineage)


def gate_by_otsu(markers: DataFrame, columns: list[str]) -> DataFrame:
    """Gate with data-driven thresholds: one row per marker comes back to build the rule."""
    table = {r["marker"]: r["threshold"] for r in otsu_thresholds(markers, columns).collect()}
    return gate_lineages(markers, table)
