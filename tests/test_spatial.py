import numpy as np
import pandas as pd
import pytest

from histomesh.operators import cells as C
from histomesh.operators.composition import composition_counts, composition_matrix
from histomesh.operators.spatial import knn_join, nearest_distance, radius_pairs


def points(seed=0, groups=3, n=120, span=500.0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        xy = rng.uniform(-span / 2, span / 2, (n, 2))
        if g == 1:  # one dense spot, one far outlier, exact duplicates
            xy[:60] = rng.normal(0, 0.5, (60, 2))
            xy[60:80] = xy[60]
            xy[80] = (40 * span, -30 * span)
        rows.append(pd.DataFrame({"g": g, "id": np.arange(n) + 1000 * g, "x": xy[:, 0], "y": xy[:, 1]}))
    return pd.concat(rows, ignore_index=True)


def brute(pdf, k, other=None, exclude=True):
    out = []
    other = pdf if other is None else other
    for g, a in pdf.groupby("g"):
        b = other[other.g == g]
        d2 = (a.x.to_numpy()[:, None] - b.x.to_numpy()) ** 2 + (a.y.to_numpy()[:, None] - b.y.to_numpy()) ** 2
        for i, row in enumerate(a.itertuples()):
            order = sorted((d2[i, j], b.id.iloc[j]) for j in range(len(b)) if not exclude or b.id.iloc[j] != row.id)
            out += [(g, row.id, r + 1, nid) for r, (_, nid) in enumerate(order[:k])]
    return sorted(out)


def right_of(df):
    return df.withColumnsRenamed({"id": "nid", "x": "nx", "y": "ny"})


@pytest.mark.parametrize("k", [1, 4, 200])
def test_knn_matches_brute_force(spark, k):
    pdf = points()
    df = spark.createDataFrame(pdf)
    got = knn_join(df, right_of(df), ["g"], k, "id", "nid", ("x", "y"), ("nx", "ny"), exclude_self=True)
    assert sorted((r.g, r.id, r.rank, r.nid) for r in got.collect()) == brute(pdf, k)


def test_knn_between_sets_and_small_groups(spark):
    a, b = points(1, groups=2, n=100), points(2, groups=1, n=2)
    got = knn_join(
        spark.createDataFrame(a), right_of(spark.createDataFrame(b)), ["g"], 5, "id", "nid", ("x", "y"), ("nx", "ny")
    )
    assert sorted((r.g, r.id, r.rank, r.nid) for r in got.collect()) == brute(a, 5, b, exclude=False)


def test_knn_with_radius_cap(spark):
    pdf = points(3, groups=1)
    df = spark.createDataFrame(pdf)
    got = knn_join(df, right_of(df), ["g"], 5, "id", "nid", ("x", "y"), ("nx", "ny"), exclude_self=True, max_radius=40.0)
    want = []
    at = pdf.set_index("id")
    for g, i, rank, j in brute(pdf, 5):
        if np.hypot(at.x[i] - at.x[j], at.y[i] - at.y[j]) <= 40.0:
            want.append((g, i, rank, j))
    assert sorted((r.g, r.id, r.rank, r.nid) for r in got.collect()) == want


def test_crowded_position_is_thinned_without_changing_the_answer(spark, monkeypatch):
    import histomesh.operators.spatial as S

    monkeypatch.setattr(S, "MAX_PER_TILE", 8)
    pdf = points(4)
    df = spark.createDataFrame(pdf)
    got = S.knn_join(df, right_of(df), ["g"], 3, "id", "nid", ("x", "y"), ("nx", "ny"), exclude_self=True)
    assert sorted((r.g, r.id, r.rank, r.nid) for r in got.collect()) == brute(pdf, 3)
    near = S.nearest_distance(df, right_of(df), ["g"], "id", "nid", ("x", "y"), ("nx", "ny"), exclude_self=True)
    at = pdf.set_index("id")
    want = {i: np.hypot(at.x[i] - at.x[j], at.y[i] - at.y[j]) for _, i, _, j in brute(pdf, 1)}
    assert {r.id: round(r.nn_dist, 9) for r in near.collect()} == {i: round(d, 9) for i, d in want.items()}


def test_nearest_distance_drops_groups_without_partner(spark):
    a = spark.createDataFrame([(0, 1, 0.0, 0.0), (1, 2, 0.0, 0.0)], "g int, id int, x double, y double")
    b = spark.createDataFrame([(0, 9, 3.0, 4.0)], "g int, nid int, nx double, ny double")
    got = nearest_distance(a, b, ["g"], "id", "nid", ("x", "y"), ("nx", "ny")).collect()
    assert [(r.id, r.nn_dist) for r in got] == [(1, 5.0)]


def test_radius_includes_self_and_boundary(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 3.0, 4.0), (1, 3, 0.0, 0.0)], "g int, id int, x double, y double")
    got = sorted((r.id, r.nbr_id) for r in radius_pairs(df, ["g"], "id", 5.0, ("x", "y")).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


# ---- contracts of cell tables


def cell_table(spark, span=800.0, n=800, images=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = [
        pd.DataFrame(
            {"image_id": f"img{i}", "cell_id": np.arange(n) + i * n, "x_um": rng.uniform(0, span, n), "y_um": rng.uniform(0, span, n),
             "cell_type": rng.choice(list("abcdef"), n)}
        )
        for i in range(images)
    ]
    return spark.createDataFrame(pd.concat(rows))


def test_pixel_coordinates_are_rejected(spark):
    with pytest.raises(ValueError, match="pixels"):
        C.validate_cells(cell_table(spark, span=50_000.0))


def test_missing_columns_are_rejected(spark):
    with pytest.raises(ValueError, match="missing"):
        C.validate_cells(cell_table(spark).drop("cell_type"))


def test_duplicate_cells_are_rejected(spark):
    df = cell_table(spark, n=50)
    with pytest.raises(ValueError, match="duplicate"):
        C.validate_cells(df.unionByName(df.limit(1)))


def test_small_images_are_skipped(spark):
    df = cell_table(spark, n=50)
    assert C.min_cells_filter(df, 200).count() == 0


def test_unknown_type_is_an_error(spark):
    with pytest.raises(ValueError, match="f"):
        C.check_vocabulary(cell_table(spark), list("abcde"))


def test_index_cell_counts_itself_and_matrix_is_complete(spark):
    df = cell_table(spark, n=200)
    vocab = list("abcdef")
    matrix = composition_matrix(df, vocab, 30.0)
    joined = matrix.join(df, ["image_id", "cell_id"]).collect()
    assert len(joined) == 600
    assert all(r[f"n_{r.cell_type}"] >= 1 for r in joined)


def test_one_position_holding_a_third_of_the_cells(spark):
    base = cell_table(spark, n=400, images=1).toPandas()
    base.loc[:130, ["x_um", "y_um"]] = 400.0
    got = composition_counts(spark.createDataFrame(base), 40.0).toPandas()
    total = got.groupby("cell_id").n.sum()
    d2 = (base.x_um.to_numpy()[:, None] - base.x_um.to_numpy()) ** 2 + (base.y_um.to_numpy()[:, None] - base.y_um.to_numpy()) ** 2
    want = dict(zip(base.cell_id, (d2 <= 1600).sum(axis=1)))
    assert total.to_dict() == want


def test_tile_joins_never_become_nested_loops(spark):
    df = cell_table(spark, n=100)
    plan = composition_matrix(df, list("abcdef"), 40.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
