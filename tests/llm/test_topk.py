import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from histomesh.llm import topk as T

SF = "/root/testdata/sf0.01"


def brute(rows, k=5, step=50):
    """rows: (vec_id, list). Plain Python integers."""
    kept = {}
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [max(-T.LIMIT, min(T.LIMIT, math.floor(256 * x))) for x in v]
        kept[vec_id] = min(kept.get(vec_id, whole), whole)
    out = []
    for q, v in kept.items():
        if q % step == 0:
            scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), c) for c, w in kept.items() if c != q)
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    return sorted(tuple(r) for r in T.top_k(frame, F.col("vec_id") % 50 == 0, **options).collect())


@pytest.mark.parametrize("shard_rows,block_rows", [(100_000, 4096), (90, 3)])
def test_table_against_brute_force(spark, shard_rows, block_rows):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = sorted(tuple(r) for r in T.top_k(table, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, block_rows=block_rows).collect())
    assert got == brute([(r.vec_id, r.embedding) for r in table.collect()])


def test_ties_repeats_nulls_and_odd_values(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], "x") for i in range(300)]
    rows += [(400 + i, [1.0, 1.0, 1.0, 1.0], None) for i in range(300)]
    rows += [(1000, None, None), (1001, [1.0, None, 0.0, 0.0], None), (1002, [float("nan"), 1.0, 0.0, 0.0], None), (1003, [float("inf")] * 4, None)]
    rows += [(None, [9.0] * 4, None), (0, rows[0][1], "x"), (1004, [2.0], None), (1050, [], None), (7, [5.0] * 4, None)]
    assert run(spark, rows, shard_rows=64, block_rows=4) == brute([(r[0], r[1]) for r in rows])


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(np.float32(10.0 ** (i % 30))), float(-i), 1.0], "") for i in range(60)]
    assert run(spark, rows) == brute([(r[0], r[1]) for r in rows])


def test_few_rows_and_none(spark):
    assert run(spark, [(0, [1.0], ""), (3, [2.0], "")]) == [(0, 1, 3, 256 * 512)]
    assert run(spark, [(0, [1.0], "")]) == [] and run(spark, []) == []


def test_bounds_leave_out_nodes():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 300, (20, 16))
    rows = np.round(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 5, (4000, 16))).astype(np.int64)
    ids = np.arange(4000)
    tree = T.BallTree(ids, rows)
    low, high = np.full(40, T.NONE), np.full(40, np.iinfo(np.int64).max)
    found = T.Search(tree, ids[:40], rows[:40], 5, low, high)
    assert found.visited < 0.5 * 40 * 4000
    again = T.Search(tree, ids[:40], rows[:40], 5, found.bar, found.bar_id)  # with the bar known, less is read
    assert again.visited <= found.visited
