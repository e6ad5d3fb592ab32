import numpy as np
import pytest
from pyspark.sql import functions as F

from histomesh.operators import cluster as U
from histomesh.operators import topics as T


def test_topic_model_takes_equal_vectors_as_one_weighted_row(spark):
    rng = np.random.default_rng(4)
    kinds = [rng.multinomial(30, [0.45, 0.45, 0.05, 0.05] if i % 2 else [0.05, 0.05, 0.45, 0.45]).tolist() for i in range(40)] + [[0, 0, 0, 0]]
    rows = [(r, i, *map(float, v)) for i, v in enumerate(kinds) for r in range(1 + 25 * (i % 3))]
    df = spark.createDataFrame(rows, "copy int, kind int, a double, b double, c double, d double")
    vectors = T.weighted_vectors(df.selectExpr("array(a, b, c, d) as x"))
    assert vectors.count() == len({tuple(v) for v in kinds}) and vectors.agg({"n": "sum"}).first()[0] == len(rows)
    # the same model from rows that are not merged
    apart = df.selectExpr("array(a, b, c, d) as x", "1L as n", "0L as draw")
    for one, two in zip(T.fit(vectors, 4, 2, 5, 1.0, 3), T.fit(apart, 4, 2, 5, 1.0, 3)):
        assert np.allclose(one, two, rtol=1e-9)
    for fraction in (1.0, 0.5):
        out = U.fit_topics(df, ["a", "b", "c", "d"], ["copy", "kind"], n_topics=2, passes=20, batch_fraction=fraction).collect()
        assert len(out) == len(rows)
        sides = {r.kind: int(np.argmax(r.topics)) for r in out if r.kind < 40}
        assert len({sides[i] for i in range(0, 40, 2)}) == len({sides[i] for i in range(1, 40, 2)}) == 1 and sides[0] != sides[1]
        assert all(abs(sum(r.topics) - (r.kind < 40)) < 1e-9 for r in out)
    with pytest.raises(Exception, match="finite counts"):
        U.fit_topics(df.withColumn("a", F.lit(float("nan"))), ["a", "b"], ["copy", "kind"], n_topics=2).count()
