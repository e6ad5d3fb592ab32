import random
import re
from fractions import Fraction

import pytest

from histomesh.llm import linedup as L

SF = "/root/testdata/sf0.001"


def words(line):
    return frozenset(w for w in re.split(r"[\x20\x09\x0B\x0C\x0D]+", line.lower()) if w)


def brute(docs, t=Fraction(4, 5), least=5):
    """{doc_id: removed line numbers} by comparing every line with all earlier ones."""
    lines = sorted({(d, i, body) for d, text in docs if d is not None and text is not None for i, body in enumerate(text.split("\n"))})
    lines = [(d, i, body, words(body)) for d, i, body in lines]
    lines = [x for x in lines if len(x[3]) >= least or (len(x[2]) >= 20 and x[3])]
    removed = {}
    for k, (d, i, body, s) in enumerate(lines):
        for e in lines[:k]:
            alike = min(len(s), len(e[3])) >= least and t.denominator * len(s & e[3]) >= t.numerator * len(s | e[3])
            if (e[0], e[1]) != (d, i) and (e[2] == body or alike):
                removed.setdefault(d, []).append(i)
                break
    return removed


def run(spark, docs, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string") if docs else spark.createDataFrame([], "doc_id long, text string")
    return {r.doc_id: list(r.removed) for r in L.removed_lines(frame, **options).collect()}


@pytest.mark.parametrize("t", [Fraction(4, 5), Fraction(3, 5)])
def test_table_against_brute_force(spark, t):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    assert run(spark, docs, threshold=t) == brute(docs, t)


def test_random_lines_at_the_threshold(spark):
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(30)]
    bases = [rng.sample(pool, rng.randint(4, 14)) for _ in range(6)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(pool)
            lines.append(" ".join(line))
        docs.append((d, "\n".join(lines)))
    for t in (Fraction(4, 5), Fraction(1, 2), Fraction(9, 10)):
        assert run(spark, docs, threshold=t) == brute(docs, t)


def test_crowd_of_variants_of_one_line(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for d in range(120):
        line = list(base)
        for _ in range(rng.randint(1, 5)):
            line[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        docs.append((d, "short one\n" + " ".join(line)))
    assert run(spark, docs) == brute(docs)


def test_edge_rows(spark):
    long_line = " ".join(f"t{i}" for i in range(30_000))
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "A b c d e"), (5, "a  B\tc d e\n"), (6, "a b c d e"), (6, "a b c d e"), (7, "a b c d e\na b c d e"),
            (8, long_line), (9, long_line + " more"), (10, "the the the the the the"), (None, "a b c d e"), (11, "a b c d"), (12, "a b c d")]
    assert run(spark, docs) == {5: [0], 6: [0], 7: [0, 1], 9: [0]}
    assert run(spark, []) == {}


def test_repeated_lines_without_blanks_go(spark):
    passage = "这是一个没有空格的很长的句子" * 9
    docs = [(1, passage + "\nerste"), (2, "zweite\n" + passage), (3, passage[:-1]), (4, "-" * 19), (5, "-" * 19), (6, " " * 40), (7, " " * 40), (8, "a" * 20), (9, "a" * 20), (10, "four words of twenty"), (11, "words four of twenty")]
    assert run(spark, docs) == brute(docs) == {2: [1], 9: [0]}


def test_only_the_shared_header_of_a_document_goes(spark):
    header = "all rights are reserved by us"
    lines = "\n".join(f"vier kurze worte {i}" for i in range(200))
    docs = spark.createDataFrame([(1, header + "\n" + lines), (2, header + "\n" + lines.replace("kurze", "andere")), (3, header), (4, header + "\n \n")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in L.clean(docs, drop_spent=True).collect()}
    assert out == {1: header + "\n" + lines, 2: lines.replace("kurze", "andere")}


def test_long_lines_meet_through_wide_parity(spark):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(300)]
    docs = []
    for d in range(60):
        line = list(base)
        for _ in range(rng.randint(10, 45)):
            line[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        docs.append((d, " ".join(line)))
    docs += [(100 + d, " ".join(f"c{rng.randrange(900)}" for _ in range(70))) for d in range(40)]
    assert run(spark, docs) == brute(docs)


def test_clean_and_report_keep_rows_and_columns(spark):
    rows = [(1, "one two three four five\nrest", "p", 1), (2, "head\none two three four five\ntail", "q", 2), (3, None, "r", 3), (None, "one two three four five", "s", 4), (2, "head\none two three four five\ntail", "q", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string, line int")
    out = L.clean(docs)
    assert out.columns == docs.columns
    assert sorted([tuple(r) for r in out.collect()], key=repr) == sorted([rows[0], (2, "head\ntail", "q", 2), rows[2], rows[3], (2, "head\ntail", "q", 2)], key=repr)
    got = sorted([(r.doc_id, r.n_lines, r.n_removed) for r in L.report(docs).collect()], key=repr)
    assert got == sorted([(1, 2, 0), (2, 3, 1), (3, 0, 0), (None, 1, 0), (2, 3, 1)], key=repr)


def test_plan_is_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = L.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_filters_are_no_literals_of_the_plan(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"a b c d e{j} f{j} g{j % 7}" for j in range(i, i + 6))) for i in range(9)], "doc_id long, text string")
    plan = L.clean(docs)._jdf.queryExecution().toString()
    assert len(plan) < 100_000


def test_only_repeated_or_similar_lines_are_looked_up(spark):
    once = [(i, f"own{i} words{i} of{i} this{i} line{i}") for i in range(50)]
    docs = [*once, (50, "said again by two of them"), (51, "said again by two of them"), (51, "said again by two of them"), (52, "said again by two of them all")]
    assert run(spark, docs) == brute(docs) == {51: [0], 52: [0]}
    sets = L.line_sets(spark.createDataFrame(docs, "doc_id long, text string"), Fraction(4, 5), 5, 20)
    assert sets.filter("repeated").count() == 1
