"""Slide metadata, tile candidates and registration quality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_diagnostic_slide(barcode) -> Column:
    return F.upper(F.col(barcode) if isinstance(barcode, str) else barcode).contains("-DX")


def slide_resolution(slides: DataFrame, properties: list[str], patch_px=224, target_mpp=0.5) -> DataFrame:
    """Resolution from the first property present; ``usable`` is false where none is."""
    mpp = F.coalesce(*[F.expr(f"try_cast({p} as double)") for p in properties])
    with_mpp = slides.withColumn("mpp", mpp)
    return with_mpp.withColumns(
        {
            "usable": F.col("mpp").isNotNull(),
            "magnification": F.bround(10.0 / F.col("mpp")).cast("int"),
            "native_patch_px": F.bround(patch_px * target_mpp / F.col("mpp")).cast("int"),
        }
    )


def require_resolution(slides: DataFrame, slide="slide_id") -> DataFrame:
    missing = [r[slide] for r in slides.filter(~F.col("usable")).select(slide).limit(20).collect()]
    if missing:
        raise ValueError(f"slides without a resolution: {missing}")
    return slides


def tile_candidates(
    slides: DataFrame, mask: DataFrame, patch: int, stride: int, min_tissue: float = 0.40, slide="slide_id"
) -> DataFrame:
    """Tile origins on a regular grid whose mask window is tissue to at least ``min_tissue``.

    ``slides``: slide, w, h, mask_w, mask_h. ``mask``: slide, mx, my, tissue (0/1) per mask pixel.
    """
    def origins(at, mask_side, side):
        """Origins whose mask window holds pixel ``at``: those around it, tested as they stand."""
        scale = F.try_divide(F.col(mask_side), F.col(side))
        last = F.floor((F.col(side) - patch) / stride).cast("int")
        low = F.greatest(F.lit(0), (F.floor((F.try_divide(F.col(at), scale) - patch) / stride) - 1).cast("int"))
        high = F.least(last, (F.floor(F.try_divide(F.col(at) + 1, scale) / stride) + 1).cast("int"))
        near = F.when((F.col(side) >= patch) & (low <= high), F.transform(F.sequence(low, high), lambda i: i * stride))

        def holds(start):
            lo = F.floor(start * scale).cast("int")
            hi = F.greatest(lo + 1, F.floor((start + patch) * scale).cast("int"))
            return (lo <= F.col(at)) & (F.col(at) < F.least(hi, F.col(mask_side)))

        return F.explode(F.filter(near, holds))

    # first along x, then along y: a pixel is copied only to the few tiles of one axis at a time
    pixels = mask.join(slides.select(slide, "w", "h", "mask_w", "mask_h"), slide)
    lines = pixels.withColumn("x0", origins("mx", "mask_w", "w")).groupBy(slide, "x0", "my", "h", "mask_h").agg(
        F.sum(F.col("tissue").cast("double")).alias("_s"), F.count("tissue").alias("_n")
    )
    tissue = lines.withColumn("y0", origins("my", "mask_h", "h")).groupBy(slide, "x0", "y0").agg(
        F.try_divide(F.sum("_s"), F.sum("_n")).alias("tissue_frac")
    )
    return tissue.filter(F.col("tissue_frac") >= min_tissue)


def cell_density(cells: DataFrame, downsample: float, on=("slide_id",), xy=("x_px", "y_px")) -> DataFrame:
    """Cells per raster pixel, clipped into the frame given by columns ``w`` and ``h``."""
    place = lambda c, side: F.greatest(F.lit(0), F.least(F.col(side) - 1, F.floor(F.col(c) / downsample))).cast("int")
    return cells.groupBy(
        *on, "h", "w", place(xy[1], "h").alias("row"), place(xy[0], "w").alias("col")
    ).agg(F.count(F.lit(1)).cast("double").alias("value"))


def gaussian_blur(raster: DataFrame, sigma: float = 2.0, on=("slide_id",)) -> DataFrame:
    """Separable Gaussian blur of sparse raster rows with mirrored borders (edge not repeated)."""
    reach = int(round(sigma * 4))
    weights = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    total = sum(weights)
    taps = F.array(*[F.struct(F.lit(i - reach).alias("o"), F.lit(w / total).alias("k")) for i, w in enumerate(weights)])
    out = raster
    for axis, side in (("col", "w"), ("row", "h")):
        # the weight of a source pixel goes to every target whose mirrored tap reads it
        last = F.col(side) - 1
        here = F.col(axis)
        images = F.array_distinct(F.array(here, -here, 2 * last - here))
        others = "row" if axis == "col" else "col"
        # pixels are moved by line before they are multiplied by the taps; the sum then needs no exchange
        spread = (
            out.repartition(*on, "h", "w", others).withColumn("_img", F.explode(images))
            .withColumn("_tap", F.explode(taps))
            .withColumn("_to", F.col("_img") + F.col("_tap.o"))
            .filter(F.col("_to").between(0, last))
        )
        out = spread.groupBy(*on, "h", "w", others, F.col("_to").alias(axis)).agg(
            F.sum(F.col("value") * F.col("_tap.k")).alias("value")
        )
    return out


def offset_xcorr(tissue: DataFrame, density: DataFrame, max_offset: int, on=("slide_id",)) -> DataFrame:
    """Circular cross-correlation of two rasters for offsets within ``max_offset`` pixels.

    Rows are sparse: ``row, col, value`` (and the frame ``h, w`` on the density side). Mean-centring
    only adds a constant to every offset, so the sum over matching pixels ranks offsets alike.

    Both rasters meet in tiles: a tissue pixel lies in one, a cell pixel is copied to those it may be moved
    into. So pixels are moved once or a few times, not once for each offset.
    """
    on, m, size = list(on), max_offset, max(16, 2 * max_offset + 2)
    tile = lambda v: F.floor(v / size).cast("long")

    def reached(at, side):
        return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-m), F.lit(m)), lambda d: tile(F.pmod(F.col(at) + d, F.col(side))))))

    def offsets(to, at, side):
        """Offsets that move ``at`` onto ``to`` in a circle of ``side`` pixels; null if none is in the window."""
        first = F.pmod(F.col(to) - F.col(at) + m, F.col(side)).cast("int") - m
        inside = F.col(to).between(0, F.col(side) - 1) & (first <= m)
        return F.when(inside, F.sequence(first, F.lit(m), F.col(side).cast("int")))

    cells = density.select(*on, F.col("row").alias("_r"), F.col("col").alias("_c"), "h", "w", F.col("value").alias("b"))
    cells = cells.withColumn("_ty", reached("_r", "h")).withColumn("_tx", reached("_c", "w"))
    a = tissue.select(*on, "row", "col", F.col("value").alias("a"), tile(F.col("row")).alias("_ty"), tile(F.col("col")).alias("_tx"))
    met = cells.join(a, [*on, "_ty", "_tx"]).select(*on, offsets("row", "_r", "h").alias("dy"), offsets("col", "_c", "w").alias("dx"), (F.col("a") * F.col("b")).alias("ab"))
    met = met.filter("dy is not null and dx is not null").withColumn("dy", F.explode("dy")).withColumn("dx", F.explode("dx"))
    return met.groupBy(*on, "dy", "dx").agg(F.sum("ab").alias("corr"))


def _verdict(best: DataFrame, on: list[str], um_per_px: float, limit_um: float) -> DataFrame:
    """Residual and verdict of one offset (dx, dy) per slide; zero offset is reported as a one-pixel bound."""
    dx, dy = F.col("dx"), F.col("dy")
    residual = F.sqrt((dx * dx + dy * dy).cast("double")) * um_per_px
    bound = F.when(residual == 0, F.lit(float(um_per_px))).otherwise(residual)
    return best.select(
        *on, dx.cast("int").alias("dx"), dy.cast("int").alias("dy"), bound.alias("residual_um"),
        (residual == 0).alias("is_bound"), F.when(bound <= limit_um, "PASS").otherwise("FAIL").alias("verdict"),
    )


def registration_residual(xcorr: DataFrame, um_per_px: float, limit_um: float = 5.0, on=("slide_id",)) -> DataFrame:
    """Best offset per slide of a windowed cross-correlation, and its verdict. An offset outside the
    window can't be seen: judge a registration by ``full_frame_residual``."""
    far = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    best = xcorr.groupBy(*on).agg(
        F.max(F.struct(F.round("corr", 6).alias("c"), (-far).alias("f"), (-F.col("dy")).alias("y"), (-F.col("dx")).alias("x"))).alias("_b")
    )
    return _verdict(best.select(*on, (-F.col("_b.x")).alias("dx"), (-F.col("_b.y")).alias("dy")), list(on), um_per_px, limit_um)


def full_frame_residual(tissue: DataFrame, density: DataFrame, um_per_px: float, limit_um: float = 5.0, max_pixels: int = 1 << 26, on: str = "slide_id") -> DataFrame:
    """Best circular offset of every slide over its whole frame, its residual and verdict.

    Rows are sparse (``row, col, value``, the frame ``h, w`` on the density side). Each slide's two
    rasters are correlated at all offsets by one Fourier transform; a frame may have ``max_pixels``
    at most, a larger one is an error. Of equal correlations (to six decimals) the nearest offset
    counts, then the smaller dy, dx. Offsets are signed: from -(h - 1) // 2 to h // 2. A slide without
    tissue or without cells has no offset and gets no row.
    """
    kind = dict(density.dtypes)[on]

    def correlate(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({on: np.zeros(0, object), "dy": np.zeros(0, np.int32), "dx": np.zeros(0, np.int32)})
        h, w = int(b["h"].iloc[0]), int(b["w"].iloc[0])
        if h * w > max_pixels:
            raise ValueError(f"the frame of {b[on].iloc[0]} has {h * w} pixels; pool the rasters first")
        frames = []
        for rows in (a, b):
            frame = np.zeros((h, w))
            np.add.at(frame, (rows["row"].to_numpy(int) % h, rows["col"].to_numpy(int) % w), rows["value"].to_numpy(float))
            frames.append(np.fft.rfft2(frame))
        corr = np.round(np.fft.irfft2(frames[0] * np.conj(frames[1]), s=(h, w)), 6)
        dy, dx = np.nonzero(corr == corr.max())
        dy, dx = np.where(dy > h // 2, dy - h, dy), np.where(dx > w // 2, dx - w, dx)
        best = np.lexsort((dx, dy, dx * dx + dy * dy))[0]
        return pd.DataFrame({on: np.array([b[on].iloc[0]], object), "dy": [dy[best]], "dx": [dx[best]]})

    left = tissue.select(on, "row", "col", "value").groupBy(on)
    right = density.select(on, "row", "col", "value", "h", "w").groupBy(on)
    best = left.cogroup(right).applyInPandas(correlate, f"`{on}` {kind}, dy int, dx int")
    return _verdict(best, [on], um_per_px, limit_um)


def on_tissue_fraction(density: DataFrame, tissue: DataFrame, on=("slide_id",)) -> DataFrame:
    """Share of cells whose raster pixel is tissue."""
    on = list(on)
    hit = density.join(tissue.select(*on, "row", "col", F.col("value").alias("t")), [*on, "row", "col"], "left")
    inside = F.sum(F.when(F.coalesce("t", F.lit(0.0)) > 0, F.col("value")).otherwise(0.0))
    return hit.groupBy(*on).agg((inside / F.sum("value")).alias("on_tissue"))


def largest_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` groups with most rows (a top-k report), smaller key first on ties."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), key).limit(n)


def top_n_by_p(results: DataFrame, n: int = 20, p="p", tie="feature") -> DataFrame:
    return results.orderBy(F.col(p).asc_nulls_last(), tie).limit(n)


def purest_patches(patches: DataFrame, n: int = 400, label="dominant", purity="purity", ties=("patch_x", "patch_y")) -> DataFrame:
    """Top ``n`` patches of each label by purity."""
    order = Window.partitionBy(label).orderBy(F.col(purity).desc(), F.col("n_cells").desc(), *ties)
    return patches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
