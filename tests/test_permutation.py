import numpy as np
import pandas as pd
import pytest

from histomesh.operators import interaction as I
from histomesh.operators import permutation as P


def brute_labels(xy, habitat, ids, offsets):
    lo, size = xy.min(0), np.maximum(xy.max(0) - xy.min(0), 1e-9)
    order = np.argsort(ids)
    out = np.empty((len(xy), len(offsets)), int)
    for p, shift in enumerate(offsets):
        moved = lo + np.fmod(xy - lo + np.array(shift) * size, size)
        d = ((moved[:, None] - xy[None, order]) ** 2).sum(2)
        out[:, p] = habitat[order][d.argmin(1)]
    return out


def table(spark, parts):
    frames = [pd.DataFrame({"sample_id": s, "patch_id": ids, "x_um": xy[:, 0], "y_um": xy[:, 1], "habitat": h}) for s, ids, xy, h in parts]
    return spark.createDataFrame(pd.concat(frames))


def sample(seed, n, span=1000.0, hole=False, kinds=4):
    rng = np.random.default_rng(seed)
    xy = rng.random((n, 2)) * span
    if hole:  # two far pieces, so that many shifted points land in the gap
        xy[:, 0] = np.where(xy[:, 0] < span / 2, xy[:, 0] * 0.3, span - (span - xy[:, 0]) * 0.3)
    xy = np.round(xy, 1)
    return rng.permutation(n * 3)[:n], xy, rng.integers(0, kinds, n)


@pytest.mark.parametrize("tile_points", [30, 10_000])
def test_toroidal_labels_against_all_distances(spark, tile_points, monkeypatch):
    monkeypatch.setattr(P, "PERMUTATIONS_AT_ONCE", 40)
    offsets = I.unit_offsets(70)
    parts = [("a", *sample(1, 150)), ("b", *sample(2, 120, hole=True)), ("c", *sample(3, 25)), ("d", np.array([5, 3]), np.array([[1.0, 1.0], [1.0, 1.0]]), np.array([1, 2]))]
    df = table(spark, parts)
    got = I.toroidal_labels(df, ["sample_id"], offsets, tile_points=tile_points).toPandas()
    for s, ids, xy, h in parts:
        wide = got[got.sample_id == s].pivot(index="patch_id", columns="perm", values="label").loc[ids].to_numpy()
        assert (wide == brute_labels(xy, h, ids, offsets)).all()


@pytest.mark.parametrize("tile_points", [60, 10_000])
@pytest.mark.parametrize("null_model", ["toroidal", "shuffle"])
def test_scores_against_counted_pairs(spark, tile_points, null_model):
    ids, xy, h = sample(7, 250, 800.0)
    df = table(spark, [("a", ids, xy, h)])
    offsets = I.unit_offsets(12)
    near = ((xy[:, None] - xy[None]) ** 2).sum(2) <= 10_000
    np.fill_diagonal(near, False)

    def freq(labels):
        one = np.eye(10)[labels]
        f = one.T @ near @ one
        return f / f.sum()

    if null_model == "toroidal":
        drawn = brute_labels(xy, h, ids, offsets)
    else:
        got = I.shuffled_labels(df, ["sample_id"], 12).toPandas().pivot(index="patch_id", columns="perm", values="label")
        drawn = got.loc[ids].to_numpy()
    null = np.stack([freq(drawn[:, p]) for p in range(12)])
    want = {(a, b): (freq(h)[a, b], null[:, a, b].mean(), null[:, a, b].std()) for a in range(10) for b in range(10)}
    rows = I.interaction_z(df, offsets=offsets if null_model == "toroidal" else None, null_model=null_model, permutations=12, tile_points=tile_points).collect()
    assert len(rows) == 100
    for r in rows:
        obs, mean, sd = want[r.a, r.b]
        assert r.observed == pytest.approx(obs, abs=1e-12) and r.null_mean == pytest.approx(mean, abs=1e-12) and r.null_sd == pytest.approx(sd, abs=1e-9)
        assert r.z == pytest.approx((obs - mean) / sd if sd > 1e-9 else 0.0, abs=1e-6)


def test_keyed_positions_are_bijections():
    for n in (1, 2, 3, 20, 64, 65, 1000):
        keys = P._permutation_keys(9, 42, n)
        out = P.keyed_positions(np.arange(n), n, keys)
        assert (np.sort(out, 0) == np.arange(n)[:, None]).all()
    assert len({tuple(c) for c in out.T}) == 9


def test_shuffles_are_as_uniform_as_plain_ones():
    n, counts = 60, np.array([30, 20, 10])
    codes = P.shuffled_codes(np.arange(n), n, counts, 4000, 1, 7)
    assert all((np.bincount(c, minlength=3) == counts).all() for c in codes.T)
    share = np.stack([(codes == k).mean(1) for k in range(3)], 1)
    assert abs(share - counts / n).max() < 5 * 0.5 / np.sqrt(4000)
    together = (codes[:-1] == 0) & (codes[1:] == 0)  # neighbours of the order
    want = counts[0] * (counts[0] - 1) / (n * (n - 1))
    assert abs(together.mean() - want) < 0.01 and abs(together.mean(1) - want).max() < 0.05


def test_other_labels_count_towards_the_total(spark):
    df = table(spark, [("a", np.arange(30), np.c_[np.arange(30.0), np.zeros(30)], np.r_[np.zeros(10, int), np.full(20, 99)])])
    got = {(r.a, r.b): r.observed for r in I.interaction_z(df, offsets=[(0.5, 0.5)]).collect()}
    assert got[0, 0] == pytest.approx(90 / 870) and sum(got.values()) == pytest.approx(90 / 870)


def test_string_ids_and_two_keys(spark):
    ids, xy, h = sample(9, 60, 300.0)
    pdf = pd.DataFrame({"slide": "s", "part": 1, "patch_id": [f"p{i:04d}" for i in ids], "x_um": xy[:, 0], "y_um": xy[:, 1], "habitat": h})
    plain = {(r.a, r.b): r.z for r in I.interaction_z(table(spark, [("a", ids, xy, h)]), offsets=I.unit_offsets(5)).collect()}
    got = {(r.a, r.b): r.z for r in I.interaction_z(spark.createDataFrame(pdf), ["slide", "part"], offsets=I.unit_offsets(5)).collect()}
    assert got == plain


def test_raster_labels_equal_all_distances():
    shifts = np.array(I.unit_offsets(40))
    crowd = np.r_[np.tile([[3.0, 4.0]], (300, 1)), np.random.default_rng(4).random((300, 2)) * 0.01, [[500.0, 900.0]]]
    line = np.c_[np.arange(50.0), np.full(50, 1e6)]
    for _, xy, h in [sample(1, 400), sample(2, 300, hole=True), sample(3, 2), (0, crowd, np.arange(601) % 7), (0, line, np.arange(50) % 3)]:
        got = P.toroidal_whole(xy[:, 0], xy[:, 1], h.astype(np.uint8), shifts)
        assert (got.T == brute_labels(xy, h, np.arange(len(xy)), shifts)).all()


def test_shuffles_of_whole_samples_are_those_of_positions():
    for n in (20, 64, 65, 457):
        counts = np.array([n // 2, n // 5, 3])
        want = P.shuffled_codes(np.arange(n), n, counts, 70, 42, -n)
        assert (P.shuffled_whole(n, counts, 70, 42, -n) == want.T).all()


def test_sums_of_a_task_are_those_of_counted_rows(spark):
    """Samples of one tile leave their task as one row per pair of labels, not one per permutation."""
    df = table(spark, [("a", *sample(5, 200, 600.0)), ("b", *sample(6, 90, 400.0, kinds=12))]).withColumn("_n", I.F.lit(200))
    for offsets in (I.unit_offsets(30), None):
        rows = P.permuted_pair_counts(df, ["sample_id"], 10, 100.0, offsets, 30).collect()
        want = {}
        for r in rows:
            obs, s, ss = want.get((r.sample_id, r.a, r.b), (0, 0, 0))
            want[r.sample_id, r.a, r.b] = (obs + r.n, s, ss) if r.perm == 0 else (obs, s + r.n, ss + r.n * r.n)
        got = P.permuted_pair_sums(df, ["sample_id"], 10, 100.0, offsets, 30).collect()
        assert {(r.sample_id, r.a, r.b): (r.obs, int(r.s), int(r.ss)) for r in got} == want and len(got) == len(want)
