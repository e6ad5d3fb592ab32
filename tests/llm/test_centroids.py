import hashlib
import math

import numpy as np
import pytest

from histomesh.llm import centroids as C

SF = "/root/testdata/sf0.001"


def brute(rows, k=8, rounds=10, size=64):
    """rows: (vec_id, list). Plain Python integers."""
    kept = []
    for vec_id, v in rows:
        if v is None or len(v) != size or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, [math.floor(max(-C.LIMIT, min(C.LIMIT, 1024 * x))) for x in v]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    choose = lambda: [min((apart(v, c), i) for i, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        chosen = choose()
        for i in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, chosen) if c == i]
            if own:
                centres[i] = [sum(x) // len(own) for x in zip(*own)]
    chosen = choose()
    inertia = {i: sum(d for d, c in chosen if c == i) for i in range(len(centres))}
    top = 2**63 - 1
    return sorted(
        [(r[0], c, d, min(top, inertia[c]), min(top, sum(inertia.values())), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for r, (d, c) in zip(kept, chosen)],
        key=repr,
    )


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, distance string")
    size = options.get("size", 64)
    return sorted([tuple(r) for r in C.with_inertia(*C.cluster(frame, **options)).collect()], key=repr), brute([(r[0], r[1]) for r in rows], size=size)


def test_table_against_plain_integers(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").limit(200)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got, want = run(spark, [(*r, "x", None) for r in rows])
    assert got == want


def test_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], None, "x") for i in range(150)]  # many ties
    rows += [(500 + i, [1.0, 1.0, 1.0, 1.0], None, "x") for i in range(100)]
    rows += [(1, [7.5, 7.5, 7.5, 7.5], None, None), (1, [7.5, 7.5, 7.5, 7.5], None, None), (None, [3.0, 3.0, 3.0, 3.25], None, None)]
    rows += [(900, None, None, None), (901, [], None, None), (902, [1.0] * 5, None, None), (903, [1.0, None, 1.0, 1.0], None, None), (904, [float("nan")] * 4, None, None), (905, [float("-inf")] * 4, None, None)]
    got, want = run(spark, rows, size=4)
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    got, want = run(spark, [(i, [i / 3.0] * 4, None, None) for i in range(n)], size=4)
    assert got == want and len(got) == n


def test_equal_rows_leave_centroids_empty(spark):
    got, want = run(spark, [(i, [2.0, 2.0], None, None) for i in range(20)] + [(99, [-5.0, 1.0], None, None)], size=2)
    assert got == want


def test_huge_components_are_cut_off(spark):
    rows = [(i, [float(np.float32(10.0 ** (i % 38))), -float(np.float32(3.0 * 10.0 ** (i % 20)))], None, None) for i in range(40)]
    got, want = run(spark, rows, size=2)
    assert got == want


def test_bounds_spare_most_distances_of_clustered_vectors():
    rng = np.random.default_rng(5)
    middles = rng.integers(-20_000, 20_000, (8, 64))
    vectors = (middles[rng.integers(0, 8, 4000)] + rng.integers(-300, 300, (4000, 64))).astype(np.int64)
    pivots = C.far_pivots(vectors[:256], 16)
    table = np.sqrt(np.stack([C._squares(vectors, p) for p in pivots], 1).astype(float))
    label, best, visited = C.nearest(vectors, table, middles.astype(np.int64), pivots)
    every = np.stack([C._squares(vectors, m) for m in middles], 1)
    assert (label == every.argmin(1)).all() and (best == every.min(1)).all()
    print("share of exact distances", visited / every.size)
    assert visited < 0.2 * every.size


def test_bounds_are_exact_for_ties_and_large_numbers():
    rng = np.random.default_rng(6)
    for scale in (2, 1 << 27):
        vectors = rng.integers(-scale, scale + 1, (500, 6))
        centres = np.r_[vectors[:5], vectors[:3]]
        pivots = C.far_pivots(vectors[:64], 6)
        table = np.sqrt(np.stack([C._squares(vectors, p) for p in pivots], 1).astype(float))
        label, best, _ = C.nearest(vectors, table, centres, pivots)
        every = np.stack([C._squares(vectors, m) for m in centres], 1)
        assert (label == every.argmin(1)).all() and (best == every.min(1)).all()
