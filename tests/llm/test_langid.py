import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from histomesh.llm import langid as L
from histomesh.llm.text import buffer_of

SF = "/root/testdata/sf0.01"
TRAIN = {"aa": ["Banana banda, ban!", "abba band 12 anna"], "bb": ["kiko kio oki", "ÖKO kok iko"]}


def naive_symbols(text):
    out = []
    for c in text:
        s = c.lower()[0] if c.isalpha() else " "
        if s != " " or (out and out[-1] != " "):
            out.append(s)
    return out if not out or out[-1] == " " else out + [" "]


def naive_log_p(train, lang, alphabet):
    """Textbook interpolated Kneser-Ney with dictionaries of strings."""
    counts = [Counter() for _ in range(L.ORDER + 1)]
    for text in train[lang]:
        s = " " * (L.ORDER - 1) + "".join(naive_symbols(text))
        for i in range(L.ORDER - 1, len(s)):
            counts[L.ORDER][s[i - L.ORDER + 1 : i + 1]] += 1
    for n in range(L.ORDER - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    history = [defaultdict(lambda: [0, 0]) for _ in range(L.ORDER + 1)]
    discount = [0.0] * (L.ORDER + 1)
    for n in range(1, L.ORDER + 1):
        once, twice = sum(v == 1 for v in counts[n].values()), sum(v == 2 for v in counts[n].values())
        discount[n] = once / (once + 2 * twice) if once and twice else 0.5
        for g, v in counts[n].items():
            history[n][g[:-1]][0] += v
            history[n][g[:-1]][1] += 1

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / alphabet
        if g[:-1] not in history[n]:
            return p(g[1:])
        total, kinds = history[n][g[:-1]]
        return max(counts[n][g] - discount[n], 0) / total + discount[n] * kinds / total * p(g[1:])

    return p


def models_of(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in TRAIN.items() for t in ts)]
    return L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))


def test_cross_entropy_equals_the_textbook_model(spark):
    models = models_of(spark)
    alphabet = 1 + len({s for ts in TRAIN.values() for t in ts for s in naive_symbols(t)})
    texts = ["ban kiko", "zzz banana", "öko", "x", "Ba..na\nna"]
    buffer, offsets = buffer_of(pa.array(texts))
    got, size, letters = L.entropies(models, buffer, offsets)
    for j, lang in enumerate(models.langs):
        p = naive_log_p(TRAIN, lang, alphabet)
        for i, t in enumerate(texts):
            s = naive_symbols(t)
            full = " " * (L.ORDER - 1) + "".join(s)
            want = -sum(math.log(p(full[k - L.ORDER + 1 : k + 1])) for k in range(L.ORDER - 1, len(full))) / len(s)
            assert abs(got[i, j] - want) < 1e-4
    assert letters.all()


def test_counts_are_over_all_documents_and_grow(spark):
    docs = spark.createDataFrame([(i, "abcd efgh", "xx") for i in range(300)], "doc_id long, text string, lang string")
    n = L.count_grams(docs).agg(F.max("n")).first()[0]
    assert n == 300


def test_held_out_accuracy(spark):
    from histomesh.llm.queries import QUERIES

    got = QUERIES["op5_langid"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    assert got.count() == 1000
    assert got.filter("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0


def test_edge_rows(spark):
    models = models_of(spark)
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "123 ...", None), (None, "banana " * 100_000, "c"), (1, None, "a"), (4, "漢𠀀", "d")], "doc_id long, text string, lang_pred string")
    rows = L.predict(docs, models).collect()
    assert [r.lang_pred for r in rows][:5] == ["und", "und", "und", "aa", "und"] and len(rows) == 6
    assert rows[5].rejected and rows[5].lang_pred == "und"
    assert L.predict(docs, models, reject=False).collect()[5].lang_pred in TRAIN
    assert L.predict(docs.limit(0), models).count() == 0
    assert {r.lang_pred for r in L.predict(docs, None).collect()} == {"und"}
    assert L.fit(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string"), F.lit(True)) is None


def test_batch_neighbours_do_not_matter(spark):
    models = models_of(spark)
    one = [L.entropies(models, *buffer_of(pa.array([t])))[0][0] for t in ["ban", "", "ko ko", " a "]]
    together = L.entropies(models, *buffer_of(pa.array(["ban", "", "ko ko", " a "])))[0]
    assert np.allclose(one, together)


def test_a_large_language_takes_nothing_from_a_small_one(spark):
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    rng = np.random.default_rng(4)
    large = ["".join(letters[k] for k in rng.integers(0, 3000, 30_000)) for _ in range(72)]  # over 2 ** 21 four-grams, most of them once
    rows = [(i, t, "large") for i, t in enumerate(large)] + [(1000, "banana koko", "small")]
    models = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8), F.lit(True))
    assert models.langs == ["large", "small"] and len(models.grams[3].hashes) > 1 << 21
    docs = spark.createDataFrame([(1, "banana koko")], "doc_id long, text string")
    assert L.predict(docs, models, reject=False).first().lang_pred == "small"


def test_rejection_limits_come_from_all_training_documents(spark):
    """More documents than any sample of a thousand: the limits are the quantiles over all of them."""
    rng = np.random.default_rng(11)
    letters = {"aa": "abcde fgh", "bb": "klmno pqr"}
    rows = [(i, "".join(rng.choice(list(letters[lang]), rng.integers(3, 30))), lang) for i in range(1800) for lang in [("aa", "bb")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = L.fit(docs, F.lit(True))
    scored = [(r.lang_pred, r.cross_entropy) for r in L.predict(docs, models, reject=False).collect() if r.cross_entropy is not None]
    want = [np.quantile([e for lang, e in scored if lang == name], 0.995) * 1.1 for name in models.langs]
    assert np.allclose(models.limits, want, rtol=1e-9)
