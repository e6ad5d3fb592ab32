import numpy as np
from pyspark.sql import functions as F

from histomesh.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def sample(n=300):
    rng = np.random.default_rng(3)
    plain = ["alpha", "beta", "gamma", "delta", "omega"]
    out = []
    for i in range(n):
        sentences = [" ".join(rng.choice(plain, 6)) for _ in range(5)]
        if i % 3 == 0:
            sentences[rng.integers(5)] += " vilestuff"
        out.append((". ".join(sentences) + ".", int(i % 3 == 0)))
    return out


def test_learns_the_word_and_locates_its_sentence(spark):
    bias, weights = T.train(sample(), 1 / 3)
    assert any("viles" in f for f in weights) and not any("alpha" in f for f in weights)
    text = "Ünï alpha beta. gamma VileStuff here! delta"
    docs = spark.createDataFrame([(1, text, 0.5), (2, "alpha. beta gamma.", None)], "doc_id long, text string, score double")
    a, b = T.score(docs, ((bias, weights), 1 / 3)).orderBy("doc_id").collect()
    assert a.score > 0.9 and b.score < 0.1 and b.offending == []
    assert [text[s.start : s.end] for s in a.offending] == [" gamma VileStuff here"]


def test_noisy_or_matches_the_product():
    z = np.array([-3.0, 0.2, -8.0, 1.5])
    assert abs(T.noisy_or(z) - (1 - np.prod(1 - 1 / (1 + np.exp(-z))))) < 1e-12


def test_edge_rows(spark):
    model = (T.train(sample(), 1 / 3), 1 / 3)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "... !!\n"), (None, "alpha beta. " * 50_000), (1, None)], "doc_id long, text string")
    rows = T.score(docs, model).collect()
    assert [r.score for r in rows if r.n_sentences == 0] == [0.0] * 4 and len(rows) == 5
    assert T.score(docs.limit(0), model).count() == 0
    assert [r.score for r in T.score(docs, (None, 0.25)).collect()] == [0, 0, 0, 0.25, 0]
    assert T.train([], 0.5) is None and T.train([("a", 1)], 1.0) is None


def test_held_out_accuracy(spark):
    from histomesh.llm.queries import QUERIES

    got = QUERIES["op10_toxicity"](spark, SF)
    assert got.count() == 1000
    hit = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert hit > 0.9
