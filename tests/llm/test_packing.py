import itertools

import duckdb
import numpy as np
from pyspark.sql import functions as F

from histomesh.llm import packing as P
from histomesh.llm.queries import packing_sql
from tools.run_checks import compare

SF = "/root/testdata/sf0.01"


def test_dynamic_programme_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 40, rng.integers(1, 9)))
        counts = rng.integers(1, 30, len(lengths))
        for k in (1, 2, 3, 5):
            got = P.optimal_buckets(lengths, counts, k)
            price = lambda ends: sum(int(c) * min(e for e in ends if e >= n) for n, c in zip(lengths, counts))
            least = min(price([*s, lengths[-1]]) for r in range(min(k, len(lengths))) for s in itertools.combinations(lengths[:-1], r))
            assert price(got) == least and len(got) <= k
    assert P.optimal_buckets(np.array([], int), np.array([], int), 3) == []


def test_against_sql_on_other_parameters(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for buckets, align, budget in ((3, 8, 1000), (12, 256, 100)):
        got = P.pack(docs, P.word_count(F.col("text")), buckets, align, budget)
        assert compare(got, con, packing_sql("documents", buckets, align, budget)) == ""


def test_batches_hold_the_budget_and_every_row(spark):
    docs = spark.createDataFrame([(i % 400, "w " * (i % 97), i) for i in range(500)] + [(None, None, 0), (7, "x", 0), (7, "x", 0)], "doc_id long, text string, bucket int")
    rows = P.pack(docs, P.word_count(F.col("text")), align=8, budget=256).toPandas()
    assert len(rows) == 503
    sizes = rows.groupby(["bucket", "batch"]).agg(n=("slot", "size"), top=("slot", "max"), length=("bucket_length", "max"))
    assert ((sizes.n * sizes.length <= 256) | (sizes.n == 1)).all() and (sizes.top + 1 == sizes.n).all()
    assert (rows.n_tokens <= rows.bucket_length).all() and rows.bucket.nunique() <= 8


def test_long_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, 5), (2, 900_000), (3, None)], "doc_id long, n long")
    rows = {r.doc_id: r for r in P.pack(docs, F.col("n"), align=64).collect()}
    assert rows[2].bucket_length >= 900_000 and rows[2].slot == 0 and rows[1].bucket_length == 64
    assert P.pack(docs.limit(0), F.col("n")).count() == 0


def test_word_count(spark):
    texts = [(None, 0), ("", 0), (" \n", 0), ("a b\tc", 3), ("é ü", 2), ("x" * 100_000, 1)]
    got = spark.createDataFrame([(t, n) for t, n in texts], "t string, n int").select(P.word_count(F.col("t")).alias("k"), "n").collect()
    assert all(r.k == r.n for r in got)


def test_one_long_row_leaves_the_others_alone(spark):
    docs = spark.createDataFrame([(i, 10 + 64 * (i % 12)) for i in range(120)] + [(999, 2_000_000)], "doc_id long, n long")
    rows = P.pack(docs, F.col("n"), buckets=13).collect()
    assert all(r.bucket_length == 64 * (1 + r.n_tokens // 64) for r in rows if r.doc_id < 999)


def test_registered_query_equals_its_sql_beside_a_long_row(spark, tmp_path):
    from histomesh.llm.queries import QUERIES, SQL

    rows = [(i, "w " * (10 + 40 * i)) for i in range(30)] + [(99, "w " * 300_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(QUERIES["op1_packing"](spark, str(tmp_path)), con, SQL["op1_packing"]) == ""
