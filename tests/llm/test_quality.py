import numpy as np
import pytest
from pyspark.sql import functions as F

from histomesh.llm import quality
from histomesh.llm.sample import fold, labelled_sample
from histomesh.llm.text import buffer_of

SF = "/root/testdata/sf0.01"


def naive_chunks(data):
    """Chunk symbols of one document, byte by byte."""
    bits = [0] * len(data)
    padded = data + b"\0" * (quality.PAD + quality.CHUNK)
    lead = b"\0" * quality.PAD + padded
    for i in range(len(data)):
        j = i + quality.PAD
        bits[i] = any(lead[j : j + 4] == lead[j - lag : j - lag + 4] for lag in quality.LAGS)
    symbols = [0 if b == 0 else b + 256 * r for b, r in zip(data, bits)]
    out, at = [], 0
    while True:
        part = symbols[at : at + quality.CHUNK + quality.WIDTH]
        out.append(part + [0] * (quality.CHUNK + quality.WIDTH - len(part)))
        at += quality.STEP
        if at + quality.CHUNK - quality.STEP >= len(data):
            return out


def test_chunks_cover_the_document_whatever_the_batch():
    texts = [b"", b"a b a b a b a b a b", bytes(range(1, 256)) * 9, b"x" * 512, b"y" * 513]
    import pyarrow as pa

    joined, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    symbols, row = quality.chunk_symbols(joined, offsets)
    for i, t in enumerate(texts):
        assert symbols[row == i].tolist() == naive_chunks(t)
    assert buffer_of(pa.array(["a", None, "é"]))[1].tolist() == [0, 1, 1, 3]


def test_gradient_step_learns_a_marker():
    rng = np.random.default_rng(1)
    text = lambda bad: " ".join(rng.choice(["ab", "cd", "ef"], 200)) + (" $$$ " if bad else " ok ") + " ".join(rng.choice(["ab", "cd", "ef"], 200))
    sample = [(text(i % 2 == 0), i % 2) for i in range(200)]
    net = quality.train(sample[:150], 0.5, epochs=8)
    data = b"".join(t.encode() for t, _ in sample[150:])
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t, _ in sample[150:]])]
    p = quality.probabilities(net, net.tables(), np.frombuffer(data, np.uint8), offsets)
    assert ((p > 0.5) == np.array([y for _, y in sample[150:]])).mean() > 0.95


def test_held_out_accuracy(spark):
    from histomesh.llm.queries import QUERIES

    got = QUERIES["op3_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    hit = got.filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert hit > 0.9
    assert got.count() == 1000 and got.filter("score is null or score < 0 or score > 1").count() == 0


def test_edge_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "a", 0.1), (2, "", None, None), (None, "w " * 300_000, "b", 2.0), (1, None, "a", 0.1)], "doc_id long, text string, lang string, score double")
    net = quality.train([("good text here", 1), ("bad $$$ bad", 0)] * 4, 0.5, epochs=2)
    rows = quality.score(docs, (net, 0.5)).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].score == rows[1].score == rows[3].score
    assert quality.score(docs.limit(0), (net, 0.5)).count() == 0
    assert {r.score for r in quality.score(docs, (None, 0.25)).collect()} == {0.25}


def test_no_labels_or_one_class(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert quality.fit(docs, labels, "quality", F.lit(True)) == (None, 1.0)
    assert quality.fit(docs, labels.limit(0), "quality", F.lit(True)) == (None, 0.5)


def test_sample_bounds_and_folds(spark):
    docs = spark.createDataFrame([(i, "x" * (10 if i else 500)) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    sample, share = labelled_sample(docs, labels, "quality", fold("doc_id", 5) != 0, 10, 60)
    assert share == pytest.approx(0.5, abs=0.2)
    assert sum(y for _, y in sample) == 6 and len(sample) == 12
