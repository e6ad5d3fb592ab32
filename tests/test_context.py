import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from histomesh.operators import classify as K
from histomesh.operators import labels as L
from histomesh.operators import lattice as G
from histomesh.operators import tiles as I
from histomesh.sources import tables as X
from histomesh.streaming.ingest import incremental_ingest


def lattice(spark, side=6, slides=2, dim=4, holes=()):
    rows = []
    for s in range(slides):
        for i in range(side * side):
            if i in holes:
                continue
            v = [float(i * dim + d) for d in range(dim)]
            rows.append((s, s * 1000 + i, i % 3, 112.0 * (i % side) + s * 1e5, 112.0 * (i // side), v))
    return spark.createDataFrame(rows, "slide_id int, patch_id int, label int, x_um double, y_um double, embedding array<double>")


def test_stride_is_recovered(spark):
    rng = np.random.default_rng(0)
    pdf = lattice(spark, 10, 1).toPandas()
    pdf[["x_um", "y_um"]] += rng.uniform(-2, 2, (len(pdf), 2))
    r = G.infer_stride(spark.createDataFrame(pdf)).first()
    assert abs(r.stride_um - 112) < 6


def test_even_window_is_rejected(spark):
    with pytest.raises(ValueError):
        G.lattice_window_join(G.to_lattice(lattice(spark), 112.0), 4)


def test_windows_edges_holes_and_slides(spark):
    p = G.to_lattice(lattice(spark, 6, 2, holes=(14,)), 112.0)
    w = G.lattice_window_join(p, 3).toPandas()
    assert w[(w.dr == 0) & (w.dc == 0)].valid.all()
    corner = w[w.patch_id == 0]
    assert corner.valid.sum() == 4
    beside = w[(w.patch_id == 13) & (w.dr == 0) & (w.dc == 1)]
    assert not beside.valid.iloc[0]
    valid = w[w.valid]
    assert ((valid.nbr_id >= 1000) == (valid.slide_id == 1)).all()


def test_collision_keeps_the_largest_id(spark):
    df = spark.createDataFrame([(0, 1, 0, 0), (0, 2, 0, 0)], "slide_id int, patch_id int, row int, col int")
    assert [r.patch_id for r in G.one_per_slot(df).collect()] == [2]
    assert G.lattice_stats(df).first().collisions == 1


def test_pyramid_shapes_and_block_means(spark):
    p = G.to_lattice(lattice(spark, 4, 1, dim=4), 112.0)
    pyr = G.pyramid_pool(p, 3).toPandas()
    assert pyr.groupby("scale").size().tolist() == [16, 4, 1]
    first = pyr[(pyr.scale == 1) & (pyr.row == 0) & (pyr.col == 0)].iloc[0].embedding
    emb = np.arange(64).reshape(16, 4)
    assert np.allclose(first, emb[[0, 1, 4, 5]].mean(axis=0))


def test_tiny_slide_has_only_its_centre(spark):
    p = G.to_lattice(lattice(spark, 6, 1).filter("patch_id < 2"), 112.0)
    s = G.scale_window_join(p, G.pyramid_pool(p, 2), 3, 2)
    assert s.count() == 4 and s.filter("dr = 0 and dc = 0").count() == 4


def test_attention_and_isolated_patches(spark):
    df = lattice(spark, 4, 2).unionByName(
        spark.createDataFrame([(0, 99, 0, 9e4, 9e4, [1.0] * 4)], "slide_id int, patch_id int, label int, x_um double, y_um double, embedding array<double>")
    ).withColumn("embedding", F.transform("embedding", lambda v: v / 100))
    links = G.neighbours(df, 4, 300.0)
    assert links.filter("patch_id = 99").count() == 0
    w = G.attention_map(links, 4).groupBy("patch_id").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in w)
    out = {r.patch_id: r.context for r in G.distance_attention(df, links, 4).collect()}
    assert out[99] == [0.0] * 4 and len(out) == 33
    pooled = {r.patch_id: r for r in G.deepset_pool(df, links, 4).collect()}
    assert pooled[99].mean == [0.0] * 4 and pooled[99].max == [0.0] * 4


def test_attention_with_given_weights(spark):
    lone = spark.createDataFrame([(1, 99, 0, 9e5, 9e5, [1.0] * 4)], "slide_id int, patch_id int, label int, x_um double, y_um double, embedding array<double>")
    df = lattice(spark, 4, 2).unionByName(lone).withColumn("embedding", F.transform("embedding", lambda v: v / 100))
    links = G.neighbours(df, 4, 300.0)
    rng = np.random.default_rng(2)
    layer = lambda: (rng.normal(size=(3, 4)), rng.normal(size=3))
    head = G.AttentionWeights(layer(), layer(), layer())
    out = {(r.slide_id, r.patch_id): r.context for r in G.distance_attention(df, links, 4, 0.7, weights=head).collect()}
    rows = links.toPandas()
    for key, part in rows.groupby(["slide_id", "patch_id"]):
        apply = lambda m, v: np.stack(v) @ m[0].T + m[1]
        q, k, v = apply(head.query, part.embedding), apply(head.key, part.nbr_vec), apply(head.value, part.nbr_vec)
        z = (q * k).sum(axis=1) / np.sqrt(3) - 0.7 * np.log1p(part.dist.to_numpy() / 100)
        e = np.exp(z - z.max())
        assert out[key] == pytest.approx((e / e.sum()) @ v, abs=1e-9)
    alone = [c for key, c in out.items() if key not in set(rows.groupby(["slide_id", "patch_id"]).groups)]
    assert alone == [[0.0] * 3]


def test_no_neighbours_equals_plain_mode(spark):
    df = lattice(spark, 4, 1)
    a = {r.patch_id: r.x for r in K.context_vectors(df, "none", 4).collect()}
    b = {r.patch_id: r.x for r in K.context_vectors(df, "graph", 4, k=0).collect()}
    assert a == b
    c = {r.patch_id: r.x for r in K.context_vectors(df, "graph", 4, k=4).collect()}
    assert all(len(c[i]) == 16 and c[i][:4] == a[i] for i in a)


def test_windows_are_not_rotation_invariant(spark):
    p = G.to_lattice(lattice(spark, 3, 1), 112.0)
    turned = p.withColumn("old", F.col("row")).withColumn("row", F.col("col")).withColumn("col", F.col("old")).drop("old")
    one = lambda q: {r.patch_id: r.window for r in G.grid_context_vector(G.scale_window_join(q, G.pyramid_pool(q, 1), 3, 1), 4).collect()}
    assert one(p)[4] != one(turned)[4]


# ---- labels


def test_patch_rules(spark):
    rows = [("bg", 0)] * 5 + [("mid", 1)] * 10 + [("pure", 2)] * 12 + [("pure", 3)] * 8 + [("mixed", 1)] * 9 + [("mixed", 2)] * 9 + [("none", -1)] * 30
    df = spark.createDataFrame([(s, 1.0, 1.0, c) for s, c in rows], "sample_id string, x_px double, y_px double, cn int")
    got = {r.sample_id: (r.label, r.n_cells) for r in L.label_patches(df, 100).collect()}
    assert got == {"bg": (10, 5), "pure": (2, 20)}


def test_sample_split_sizes_and_error(spark):
    df = spark.createDataFrame([(i,) for i in range(14) for _ in range(3)], "sample_id int")
    got = L.sample_split(df, "sample_id", {"train": 8, "val": 2, "test": 2}).groupBy("split").count()
    assert {r.split: r["count"] for r in got.collect()} == {"train": 8, "val": 2, "test": 2, "unused": 2}
    with pytest.raises(ValueError):
        L.sample_split(df, "sample_id", {"train": 20})


def test_balanced_resample_evens_the_classes(spark):
    for rare, n in ((400, 4000), (20, 60_000), (1, 2_000)):  # the rare class repeats its rows 5, 1500 and 1000 times
        df = spark.range(n).select("id", F.when(F.col("id") < n - rare, 0).otherwise(1).alias("label"))
        got = {r.label: r["count"] for r in L.balanced_resample(df, "label", "id").groupBy("label").count().collect()}
        assert all(abs(got[c] - n / 2) < 5 * (n / 2) ** 0.5 for c in (0, 1)), (rare, got)


def test_balanced_resample_tells_rows_of_two_slides_apart(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("slide"), F.floor(F.col("id") / 2).alias("patch"), F.lit(1).alias("label"))
    copies = L.balanced_resample(df, "label", ["slide", "patch"]).groupBy("patch").agg(F.collect_set("slide").alias("s"))
    assert copies.filter(F.size("s") == 1).count() > 100


def test_pooled_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000)
    a = {r.id for r in L.pooled_fit_sample(df, 700, ["id"]).collect()}
    b = {r.id for r in L.pooled_fit_sample(df.repartition(3), 700, ["id"]).collect()}
    assert len(a) == 700 and a == b


# ---- tiles


def tile_pixels(spark, images):
    rows = [(i, x, y, *map(int, im[y, x])) for i, im in enumerate(images) for y in range(im.shape[0]) for x in range(im.shape[1])]
    return spark.createDataFrame(rows, "tile_id int, x int, y int, r int, g int, b int")


def test_tissue_blob_is_found(spark):
    im = np.full((80, 40, 3), 240, dtype=int)
    im[10:70, 10:30] = (180, 60, 140)
    mask = I.tissue_mask(tile_pixels(spark, [im])).toPandas()
    inside = mask[mask.y.between(14, 65) & mask.x.between(14, 25)]
    outside = mask[(mask.x < 5) | (mask.x > 35)]
    assert len(mask) == 3200 and inside["mask"].all() and not outside["mask"].any()


def test_artefact_signals(spark):
    flat = np.full((16, 16, 3), 200, dtype=int)
    pen = np.zeros((16, 16, 3), dtype=int)
    pen[..., 2], pen[..., 1] = 220, 40
    dark = np.full((16, 16, 3), 20, dtype=int)
    f = {r.tile_id: r for r in I.artefact_flags(tile_pixels(spark, [flat, pen, dark])).collect()}
    assert f[0].blur_var == 0 and f[1].pen_frac == 1.0 and f[2].fold_frac == 1.0
    assert I.artefact_flags(tile_pixels(spark, [flat])).filter(~I.is_artefact()).count() == 0


def test_macenko_recovers_planted_stains(spark):
    rng = np.random.default_rng(0)
    basis = np.array([[0.65, 0.30], [0.70, 0.90], [0.29, 0.30]])  # other stains than the reference ones
    basis /= np.linalg.norm(basis, axis=0)
    amounts = rng.uniform(0.1, 1.5, (1600, 2))
    amounts[:80, 1], amounts[80:160, 0] = 0, 0  # pixels of one stain only
    paint = lambda stains, a: np.clip(256 * np.exp(-(a @ stains.T)) - 1, 0, 255).astype(int).reshape(40, 40, 3)
    white = np.full((40, 40, 3), 250, dtype=int)
    out = I.macenko_normalize(tile_pixels(spark, [paint(basis, amounts), white])).toPandas().sort_values(["tile_id", "y", "x"])
    got = {k: g[["r", "g", "b"]].to_numpy() for k, g in out.groupby("tile_id")}
    assert (got[1] == 250).all()
    want = paint(I.REFERENCE_STAIN, amounts * I.REFERENCE_MAX / np.percentile(amounts, 99, axis=0)).reshape(-1, 3)
    assert np.abs(got[0] - want).mean() < 4


def test_macenko_leaves_one_stain_alone(spark):
    shades = np.exp(-np.linspace(0.2, 1.5, 256)[:, None] * np.array([[0.65, 0.70, 0.29]]))
    grey = np.clip(256 * shades - 1, 0, 255).astype(int).reshape(16, 16, 3)
    flat = np.full((16, 16, 3), 90, dtype=int)
    out = I.macenko_normalize(tile_pixels(spark, [flat, grey])).toPandas().sort_values(["tile_id", "y", "x"])
    assert (out[out.tile_id == 0][["r", "g", "b"]] == 90).all().all() and len(out) == 512
    assert I.macenko_normalize(tile_pixels(spark, [flat]).limit(0)).count() == 0


def test_encoder_takes_tiles_of_mixed_size(spark):
    a, b = np.zeros((4, 4, 3), int), np.ones((2, 6, 3), int)
    tiles = I.pack_tiles(tile_pixels(spark, [a, b, a]))
    got = {r.tile_id: r.embedding for r in I.encode_tiles(tiles, lambda: (lambda x: x.reshape(len(x), -1).mean(1, keepdims=True)), ["tile_id"]).collect()}
    assert got == {0: [0.0], 1: [1.0], 2: [0.0]}


def test_encoder_is_loaded_per_task(spark):
    im = np.arange(4 * 4 * 3).reshape(4, 4, 3)
    tiles = I.pack_tiles(tile_pixels(spark, [im, im + 1]))
    got = {r.tile_id: r.embedding for r in I.encode_tiles(tiles, lambda: (lambda x: x.reshape(len(x), -1)[:, :2]), ["tile_id"]).collect()}
    assert got == {0: [0.0, 1.0], 1: [1.0, 2.0]}


# ---- writes and ingest


def test_write_cached_skips_and_forces(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("s1", 1), ("s2", 1)], "slide_id string, v int")
    X.write_cached(a.filter("slide_id = 's1'"), path)
    X.write_cached(a.withColumn("v", F.lit(2)), path)
    read = lambda: {r.slide_id: r.v for r in spark.read.parquet(path).collect()}
    assert read() == {"s1": 1, "s2": 2}
    X.write_cached(a.withColumn("v", F.lit(3)).filter("slide_id = 's1'"), path, force=True)
    assert read() == {"s1": 3, "s2": 2}


def test_ingest_keeps_every_row_of_a_slide(spark, tmp_path):
    base, schema = str(tmp_path), "slide_id string, v int"
    arrivals = ([("s1", v) for v in range(100)], [("s1", 900), ("s2", 2)], [])
    for k, rows in enumerate(arrivals):
        if rows:  # the first slide comes in several files, one to a micro-batch
            spark.createDataFrame(rows, schema).repartition(4 if k == 0 else 1).write.mode("append").parquet(f"{base}/in")
        for _ in range(2):  # a repeated call changes nothing
            incremental_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/state", schema, max_files=1)
    got = sorted((r.slide_id, r.v) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == sorted(arrivals[0] + arrivals[1])


def test_ingest_replaces_a_batch_that_is_run_again(spark, tmp_path):
    base, schema = str(tmp_path), "slide_id string, v int"
    spark.createDataFrame([("s1", 1), ("s2", 2)], schema).write.parquet(f"{base}/in")
    for state in ("a", "b"):  # a lost state reads the files again
        incremental_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/{state}", schema)
    assert sorted((r.slide_id, r.v) for r in spark.read.parquet(f"{base}/out").collect()) == [("s1", 1), ("s2", 2)]


def test_unmarked_keys_are_written_again(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 1)], "slide_id string, v int")
    a.limit(1).write.partitionBy("slide_id").parquet(path)  # what a crash left of s1
    X.write_cached(a, path)
    assert sorted((r.slide_id, r.v) for r in spark.read.parquet(path).collect()) == [("s1", 1), ("s1", 2), ("s2", 1)]


def test_key_value_text(spark):
    df = spark.createDataFrame([("a=1, b = two",)], "s string")
    assert df.select(X.parse_key_values("s").alias("m")).first().m == {"a": "1", "b": "two"}


def test_csv_needs_a_schema(spark):
    with pytest.raises(ValueError):
        X.read_table(spark, "/nowhere/x.csv")


def test_full_frame_registration_finds_far_offsets(spark):
    from histomesh.operators import slides as S

    spots = [(5, 7), (20, 41), (33, 12), (50, 60)]
    rows = [("far", r, c, 1.0) for r, c in spots] + [("same", r, c, 1.0) for r, c in spots]
    tissue = spark.createDataFrame(rows, "slide_id string, row int, col int, value double")
    moved = [("far", (r - 12) % 64, (c + 30) % 64, 2.0, 64, 64) for r, c in spots] + [("same", r, c, 2.0, 64, 64) for r, c in spots] + [("bare", 1, 1, 1.0, 64, 64)]
    density = spark.createDataFrame(moved, "slide_id string, row int, col int, value double, h int, w int")
    got = {r.slide_id: r for r in S.full_frame_residual(tissue, density, 1.0).collect()}
    assert set(got) == {"far", "same"}
    assert (got["far"].dy, got["far"].dx, got["far"].verdict) == (12, -30, "FAIL")
    assert got["same"].is_bound and got["same"].verdict == "PASS"
    with pytest.raises(Exception, match="pixels"):
        S.full_frame_residual(tissue, density, 1.0, max_pixels=100).collect()


def test_ecotype_numerals():
    from histomesh.operators.cluster import roman

    assert [roman(i) for i in (1, 4, 8, 9, 14, 40, 99, 1990)] == ["I", "IV", "VIII", "IX", "XIV", "XL", "XCIX", "MCMXC"]
