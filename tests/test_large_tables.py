"""Faults that showed on larger tables only, by their cause on small ones."""

import math
import re
from unittest import mock

import numpy as np
from pyspark.sql import functions as F

from histomesh.checks.catalogue import QUERIES, SQL
from histomesh.operators import agreement as A
from histomesh.operators import cells as C
from histomesh.operators import cluster as U
from histomesh.operators import grouptests as G
from histomesh.operators import kmeans as KM
from histomesh.operators import slides as L
from histomesh.operators import tiles as T
from histomesh.session import durable
from histomesh.sources import tables as X
from tools.run_checks import compare, oracle_connection

SF = "/root/testdata/sf0.001"


def test_tile_candidates_broadcast_no_mask_and_no_tiles(spark):
    plan = QUERIES["tile_candidates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    blocks = re.findall(r"BroadcastExchange(?:(?!BroadcastExchange).)*?Scan", initial, re.S)
    assert len(blocks) <= 1 and not any("Generate" in b for b in blocks)  # the slides, never rows per pixel


def test_tile_candidates_of_odd_frames(spark):
    frames = [(1, 1000, 700, 33, 21), (2, 50, 900, 4, 4), (3, 640, 640, 2, 3), (4, 90, 90, 90, 90), (5, 0, 90, 1, 1)]
    patch, stride = 90, 40
    on = lambda s, x, y: (7 * s + 3 * x + 5 * y + x * y) % 3 != 0
    mask = [(s, x, y, int(on(s, x, y))) for s, _, _, mw, mh in frames for x in range(mw) for y in range(mh)]
    want = {}
    for s, w, h, mw, mh in frames:
        for x0 in range(0, w - patch + 1, stride):
            for y0 in range(0, h - patch + 1, stride):
                spans = []
                for start, side, m in ((x0, w, mw), (y0, h, mh)):
                    lo = math.floor(start * (m / side))
                    spans.append(range(lo, min(max(lo + 1, math.floor((start + patch) * (m / side))), m)))
                hits = [on(s, x, y) for x in spans[0] for y in spans[1]]
                if sum(hits) / len(hits) >= 0.4:
                    want[s, x0, y0] = sum(hits) / len(hits)
    out = L.tile_candidates(
        spark.createDataFrame(frames, "slide_id int, w int, h int, mask_w int, mask_h int"),
        spark.createDataFrame(mask, "slide_id int, mx int, my int, tissue int"), patch, stride,
    )
    assert {(r.slide_id, r.x0, r.y0): r.tissue_frac for r in out.collect()} == want


def test_windows_of_many_lines_are_reduced_together(spark):
    rng = np.random.default_rng(5)
    images = {i: rng.integers(0, 256, (6, 5 if i % 3 else 9)) for i in range(30)}
    rows = [(i, y, [int(v) for v in line]) for i, im in images.items() for y, line in enumerate(im)]
    lines = spark.createDataFrame(rows, "tile_id int, y int, line array<int>").coalesce(1)
    together = T._window_lines(lines, 3, "tile_id", lambda w: np.full(len(w), len(w))).collect()
    assert max(max(r.line) for r in together) > 9  # more window rows than one line has
    got = {(r.tile_id, r.y): list(r.line) for r in T.median_lines(lines, 3).collect()}
    for i, im in images.items():
        wide = np.pad(im, 1, mode="edge")
        for y in range(im.shape[0]):
            assert got[i, y] == [int(np.median(wide[y : y + 3, x : x + 3])) for x in range(im.shape[1])]


def test_otsu_without_keys_does_not_deal_values_by_marker(spark):
    df = spark.range(2000).selectExpr("cast(id % 97 as double) as a", "cast(id % 89 as double) as b")
    with mock.patch.object(F, "broadcast", wraps=F.broadcast) as called:
        got = C.otsu_thresholds(df, ["a", "b"]).collect()
        assert called.call_count == 1 and len(got) == 2
        C.otsu_thresholds(df.withColumn("k", F.lit(1)), ["a", "b"], ["k"])
        assert called.call_count == 1  # with keys the extents grow with the table


def test_fisher_exact_needs_no_window(spark):
    table = spark.createDataFrame([(g, i % (g + 2) == 0, i % 3 == 0) for g in range(3) for i in range(40)], "gene int, mutated boolean, in_group boolean")
    out = G.fisher_exact(table)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        odds = lambda k: math.comb(r.a + r.b, k) * math.comb(r.c + r.d, r.a + r.c - k)
        every = [odds(k) for k in range(max(0, r.a - r.d), min(r.a + r.b, r.a + r.c) + 1)]
        assert math.isclose(r.p, min(1.0, sum(x for x in every if x <= odds(r.a) * (1 + 1e-9)) / sum(every)), rel_tol=1e-6)


def test_starts_of_kmeans_share_their_passes(spark):
    rng = np.random.default_rng(3)
    x = np.repeat([[0.0, 0.0], [8.0, 0.0], [0.0, 8.0]], 400, 0) + rng.normal(0, 0.5, (1200, 2))
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "image_id int, topics array<double>")
    with mock.patch.object(KM, "members", wraps=KM.members) as passes:
        out = U.assign_cns(rows, 3, 6, ["image_id"]).toPandas().sort_values("image_id")
    assert passes.call_count <= 53 and max(len(c.args[1]) for c in passes.call_args_list) == 6
    assert sorted(out.cn.value_counts()) == [400, 400, 400] and all(out.cn[i : i + 400].nunique() == 1 for i in (0, 400, 800))
    (total, cost), (every, least) = KM.members(rows.selectExpr("topics as x", "xxhash64(image_id) as draw"), [np.array([[4.0, 0.0], [0.0, 4.0], [4.0, 0.0]]), x[:2]])
    away = np.stack([((x - c) ** 2).sum(1) for c in ([4.0, 0.0], [0.0, 4.0])])
    assert total[2, -2] == 0 and list(total[:2, -2]) == list(np.bincount(away.argmin(0)))  # equal centres: the first has the members
    assert math.isclose(cost, away.min(0).sum()) and np.allclose(every[:, :2].sum(0), x.sum(0)) and least > 0
    few = spark.createDataFrame([(i, [float(i % 2)]) for i in range(10)], "image_id int, topics array<double>")
    assert U.assign_cns(few, 5, 2, ["image_id"]).select("cn").distinct().count() == 2  # fewer distinct rows than classes


def test_sweep_judges_all_numbers_in_two_passes(spark):
    rng = np.random.default_rng(9)
    x = rng.random((600, 3))
    rows = durable(spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "image_id int, topics array<double>"))
    fits = [x[:4], x[10:17]]
    with mock.patch.object(KM, "_totals", wraps=KM._totals) as passes:
        got = KM.judged(rows.selectExpr("topics as x", "xxhash64(image_id) as draw"), fits)
    assert passes.call_count == 2
    labels = [((x[:, None] - c[None]) ** 2).sum(2).argmin(1).tolist() for c in fits]
    for i, found in enumerate(got):
        pdf = spark.createDataFrame([(v.tolist(), a, b) for v, a, b in zip(x, labels[i], labels[0])], "features array<double>, cn int, before int")
        want = A.silhouette_squared(pdf).first()[0], A.davies_bouldin(pdf).first()[0], A.adjusted_rand(pdf, (), "before", "cn").first()["ari"], A.inertia(pdf).first()[0]
        assert (found[2] is None) == (i == 0)
        assert all(f is None or math.isclose(f, w, rel_tol=1e-9) for f, w in zip(found, want))
    assert [r.k for r in U.sweep_k(rows, 2, 4, 1, ["image_id"]).collect()] == [2, 3, 4]


def test_groups_of_few_points_take_no_rounds(spark):
    rng = np.random.default_rng(11)
    rows = [(g, i, float(10 * (i % 3) + rng.normal()), float(rng.normal())) for g, n in enumerate((2, 60, 90)) for i in range(n)]
    points = spark.createDataFrame([*rows, (3, 0, None, 1.0), (3, 1, 2.0, 1.0), (3, 2, 3.0, 1.0)], "s int, i int, a double, b double")
    with mock.patch.object(U, "durable", wraps=U.durable) as written:
        got = {(r.s, r.i): r.cluster for r in U.grouped_kmeans(points.filter("s < 3"), "s", "i", ["a", "b"]).collect()}
        assert written.call_count == 2 and len(got) == 152
    with mock.patch.object(U, "IN_ONE_TASK", 70):
        both = {(r.s, r.i): r.cluster for r in U.grouped_kmeans(points, "s", "i", ["a", "b"]).collect()}
    assert len(both) == 155 and {k: v for k, v in both.items() if k[0] < 3} == got  # by rounds the same classes


def test_read_log_is_written_in_parts(spark):
    with mock.patch.object(X, "read_log", wraps=X.read_log) as read:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = QUERIES["read_log"](spark, SF)
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        parts = spark.read.text(read.call_args.args[1])
        assert len(parts.inputFiles()) > 1
        con = oracle_connection(SF)
        assert compare(got, con, SQL["read_log"]) == ""  # what a part announces holds in the next ones
