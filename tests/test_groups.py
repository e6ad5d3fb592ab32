import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from histomesh.functions import tails as T
from histomesh.operators import barrier as B
from histomesh.operators import grouptests as G
from histomesh.operators import slides as S


def test_tails_against_published_quantiles(spark):
    one = spark.range(1)
    got = one.select(
        T.t_two_sided(F.lit(2.228138852), F.lit(10.0)).alias("t10"), T.t_two_sided(F.lit(-12.7062047), F.lit(1.0)).alias("t1"), T.t_two_sided(F.lit(1.959963985), F.lit(1e7)).alias("tn"),
        T.f_tail(F.lit(4.102821), F.lit(2.0), F.lit(10.0)).alias("f"), T.f_tail(F.lit(1.0), F.lit(7.0), F.lit(7.0)).alias("half"),
        T.gamma_tail(F.lit(3.5), F.lit(14.06714 / 2)).alias("c7"), T.gamma_tail(F.lit(0.5), F.lit(3.841459 / 2)).alias("c1"), T.gamma_tail(F.lit(50.0), F.lit(124.3421 / 2)).alias("c100"),
        T.log_gamma(F.lit(0.5)).alias("g"), T.log_gamma(F.lit(171.0)).alias("big"), T.beta_share(F.lit(0.0), F.lit(2.0), F.lit(3.0)).alias("zero"),
    ).first()
    for name in ("t10", "t1", "tn", "f", "c7", "c1", "c100"):
        assert got[name] == pytest.approx(0.05, abs=2e-6), name
    assert got.half == pytest.approx(0.5, abs=1e-12) and got.zero == 0
    assert got.g == pytest.approx(math.log(math.pi) / 2, abs=1e-12) and got.big == pytest.approx(math.lgamma(171), rel=1e-14)


def test_equal_and_nearly_equal_groups(spark):
    rows = [("same", i % 2, float(i // 2)) for i in range(10)] + [("flat", i % 2, 1.0) for i in range(6)] + [("one", 0, 2.0), ("none", None, 1.0), ("gap", 0, None)]
    long = spark.createDataFrame(rows, "feature string, g int, value double")
    t = {r.feature: r for r in G.t_test(long, "g").collect()}
    assert set(t) == {"same"} and t["same"].statistic == 0 and t["same"].p == pytest.approx(1.0)
    u = {r.feature: r for r in G.mann_whitney(long, "g").collect()}
    assert u["same"].statistic == 12.5 and u["same"].p == pytest.approx(1.0) and u["flat"].z is None
    assert {r.feature for r in G.anova(long, "g").collect()} == {"same"} == {r.feature for r in G.kruskal(long, "g").collect()}


def test_two_groups_agree_across_tests(spark):
    rng = np.random.default_rng(2)
    rows = [(f"f{j}", int(i % 2), float(rng.normal() + j * (i % 2))) for j in range(3) for i in range(41)]
    long = spark.createDataFrame(rows, "feature string, g int, value double")
    t, f = ({r.feature: r for r in fn(long, "g").collect()} for fn in (G.t_test, G.anova))
    for k in t:
        assert t[k].statistic ** 2 == pytest.approx(f[k].statistic) and t[k].p == pytest.approx(f[k].p, rel=1e-9)
    welch = {r.feature: r for r in G.t_test(long, "g", equal_variance=False).collect()}
    assert all(welch[k].df <= t[k].df and abs(welch[k].statistic - t[k].statistic) < 0.2 for k in t)


def plain_fisher(a, b, c, d):
    n, row, col = a + b + c + d, a + b, a + c
    p = {k: math.comb(row, k) * math.comb(n - row, col - k) / math.comb(n, col) for k in range(max(0, a - d), min(row, col) + 1)}
    return min(1.0, sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)))


def test_fisher_against_enumeration(spark):
    tables = [(3, 1, 1, 3), (8, 2, 1, 5), (0, 5, 5, 0), (10, 0, 0, 0), (1, 1, 1, 1), (30, 12, 5, 40), (0, 0, 4, 6)]
    rows = [(i, bool(h), bool(g)) for i, t in enumerate(tables) for (h, g), n in zip(itertools.product((1, 0), (1, 0)), t) for _ in range(n)]
    rows += [(0, None, True), (0, True, None)]
    got = {r.gene: r for r in G.fisher_exact(spark.createDataFrame(rows, "gene int, mutated boolean, in_group boolean")).collect()}
    for i, t in enumerate(tables):
        assert (got[i].a, got[i].b, got[i].c, got[i].d) == t and got[i].p == pytest.approx(plain_fisher(*t), abs=1e-10)
    assert got[0].p == pytest.approx(0.48571428571) and got[3].odds_ratio is None  # the tea tasting table


def cells(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["image_id", "cell_id", "cell_type", "x_um", "y_um"]))


def test_barrier_on_a_chain_and_an_island(spark):
    line = ["tumour", "caf", "immune", "immune", "caf", "immune"]
    rows = [("a", i, t, 10.0 * i, 0.0) for i, t in enumerate(line)] + [("a", 100 + i, "immune", 5000.0 + i, 0.0) for i in range(4)]
    rows += [("b", 200 + i, t, 10.0 * i, 0.0) for i, t in enumerate(["tumour", "immune", "immune", "other", "immune"])] + [("c", 300, "immune", 0.0, 0.0), ("c", 301, "caf", 1.0, 0.0)]
    got = {r.image_id: r for r in B.barrier_score(cells(spark, rows), "immune", "tumour", "caf", k=1).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.n_immune, a.n_adjacent, a.n_unreached, a.n_scored, a.n_positive, a.score) == (7, 0, 4, 3, 3, 1.0)
    assert (b.n_immune, b.n_adjacent, b.n_scored, b.n_positive) == (3, 1, 2, 0) and b.score == 0.0
    assert (c.n_unreached, c.n_scored, c.score) == (1, 0, None)


def test_barrier_against_plain_search(spark):
    rng = np.random.default_rng(4)
    kinds = rng.choice(["tumour", "immune", "caf"], 120, p=[0.1, 0.5, 0.4])
    xy = rng.random((120, 2)) * 100
    d = ((xy[:, None] - xy[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.zeros((120, 120), bool)
    for i in range(120):
        near[i, np.argsort(d[i], kind="stable")[:3]] = True
    near |= near.T
    state = {i: (0, 0) for i in range(120) if kinds[i] == "tumour"}
    frontier = dict(state)
    while frontier:
        reached = {}
        for i, (h, on) in frontier.items():
            for j in np.flatnonzero(near[i]):
                if j not in state:
                    value = (h + 1, on + (kinds[i] == "caf"))
                    reached[j] = min(reached.get(j, value), value)
        state |= reached
        frontier = reached
    want = [state[i] for i in range(120) if kinds[i] == "immune" and i in state and state[i][0] >= 2]
    r = B.barrier_score(cells(spark, [("a", i, str(kinds[i]), *map(float, xy[i])) for i in range(120)]), "immune", "tumour", "caf", k=3).first()
    assert (r.n_scored, r.n_positive) == (len(want), sum(on > 0 for _, on in want))


def moved_rows(df) -> int:
    """Rows that the exchanges of a finished plan moved."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    done, total = [plan.executedPlan()], 0
    while done:
        node = done.pop()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        done += [children.apply(i) for i in range(children.size())]
    return total


def raster(spark, rng, h, w, n):
    at = rng.choice(h * w, n, replace=False)
    rows = [(s, int(a) // w, int(a) % w, h, w, float(v)) for s in (1, 2) for a, v in zip(at, rng.integers(1, 9, n))]
    return spark.createDataFrame(rows, "slide_id int, row int, col int, h int, w int, value double")


def test_offset_xcorr_in_tiles_moves_pixels_not_offsets(spark):
    rng = np.random.default_rng(21)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for h, w, m in ((37, 40, 3), (5, 40, 4)):  # the second frame is smaller than the window
            density, tissue = raster(spark, rng, h, w, 120), raster(spark, rng, h, w, 150).drop("h", "w")
            got = S.offset_xcorr(tissue, density, m)
            if h > 5:
                assert moved_rows(got) < 2 * (120 * 4 + 150) + 2 * 49 * spark.sparkContext.defaultParallelism
            frames = {}
            for name, rows in (("d", density.collect()), ("t", tissue.collect())):
                for r in rows:
                    frames.setdefault((name, r.slide_id), np.zeros((h, w)))[r.row, r.col] = r.value
            want = {}
            for s in (1, 2):
                for dy in range(-m, m + 1):
                    for dx in range(-m, m + 1):
                        value = (np.roll(frames["d", s], (dy, dx), (0, 1)) * frames["t", s]).sum()
                        if value:
                            want[s, dy, dx] = value
            assert {(r.slide_id, r.dy, r.dx): r["corr"] for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_blur_moves_pixels_before_the_taps(spark):
    rng = np.random.default_rng(22)
    got = S.gaussian_blur(raster(spark, rng, 40, 40, 200), 1.0)
    assert moved_rows(got) <= 2 * 200 + 2 * 1600
