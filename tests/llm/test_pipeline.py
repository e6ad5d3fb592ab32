import pytest

import corpus_pipeline as C
from histomesh.session import durable
from tests.llm.test_decontaminate import naive_contaminated
from tests.llm.test_linedup import brute as brute_lines
from tests.llm.test_linedup import words
from tests.llm.test_neardup import brute as brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in C.STAGES:
        out.append(durable(stage(spark, out[-1], SF)))
    return out


def table(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[1:-1])
    assert [name for name, _ in C.STAGES][0] == "quality classifier" and len(C.STAGES) == 5


def test_quality_removes_junk_and_keeps_clean(spark, steps):
    before, after = table(steps[0]), table(steps[1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(before[d] == after[d] for d in after)
    good, bad = [d for d in labels if labels[d] == 1], [d for d in labels if labels[d] == 0]
    assert sum(d in after for d in good) >= 0.95 * len(good) and sum(d in after for d in bad) <= 0.5 * len(bad)


def test_lines_against_brute_force(steps):
    before, after = table(steps[1]), table(steps[2])
    removed = brute_lines([(d, r.text) for d, r in before.items()])
    want = {}
    for d, r in before.items():
        rest = [x for i, x in enumerate(r.text.split("\n")) if i not in removed.get(d, [])]
        if d not in removed or any(words(x) for x in rest):
            want[d] = "\n".join(rest)
    assert {d: r.text for d, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_groups_against_brute_force(steps):
    before, after = table(steps[2]), table(steps[3])
    groups = brute_groups([(d, r.text) for d, r in before.items()], 5)
    assert set(after) == {d for d, _, c in groups if d == c} and all(before[d] == after[d] for d in after)


def test_leaks_against_brute_force(spark, steps):
    before, after = table(steps[3]), table(steps[4])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in naive_contaminated([(d, r.text) for d, r in before.items()], items)}
    assert set(after) == set(before) - leaks


def test_packing_takes_every_document(steps):
    before, rows = table(steps[4]), steps[5].collect()
    assert sorted(r.doc_id for r in rows) == sorted(before)
    assert all(r.n_tokens == len(before[r.doc_id].text.split()) and r.n_tokens <= r.bucket_length for r in rows)
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)
    lengths = sorted({r.bucket_length for r in rows})
    assert len(lengths) <= 8


def test_edge_documents_pass_all_stages(spark, steps):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f", None, "s", 11), (3, "x y z " * 60_000, "en", "s", 1), (1, None, None, None, None), (4, "p q r s t u", "en", None, 11), (4, "p q r s t u", "en", None, 11)]
    docs = spark.createDataFrame(rows, columns)
    for _, stage in C.STAGES[1:4]:
        docs = durable(stage(spark, docs, SF))
    ids = sorted([r.doc_id for r in docs.collect()], key=repr)
    assert ids == sorted([1, 2, 3, 4, None], key=repr)
    assert C.STAGES[4][1](spark, docs, SF).count() == 5
    for _, stage in C.STAGES:
        assert stage(spark, spark.createDataFrame([], columns), SF).count() == 0


def test_run_gives_the_last_stage(spark, steps):
    assert C.run(spark, SF).count() == steps[5].count()
