import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from histomesh.llm import merkle as M
from histomesh.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    out = ""
    for v in (row[0], row[3], row[2], row[4], text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def reduce(nodes):
    """All levels of one tree, by plain lists."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append((run[: at % 8], run[at % 8 + 1 :]))
        at //= 8
    return out


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars); the contract's columns, sorted."""
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: (sorted(langs[x], key=lambda t: t[:3]),) for x in order}
    trees = {x: (m[0], reduce([t[2] for t in m[0]])) for x, m in trees.items()}
    top = reduce([trees[x][1][-1][0] for x in order])
    out = []
    for k, x in enumerate(order):
        members, tree = trees[x]
        for i, (_, _, own, r) in enumerate(members):
            path = siblings(tree, i) + siblings(top, k)
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h = leaf(r, text)
            for before, after in path:
                h = sha("".join(before) + h + "".join(after))
            proof = sha("".join("".join(b) + "".join(a) for b, a in path))
            out.append((r[0], own, tree[-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return sorted(out, key=repr)


def query(spark, rows, tmp_path):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op11_merkle"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in out.collect()], key=repr)


def test_edges_against_plain_lists(spark, tmp_path):
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(1100)]  # over two stored levels
    rows += [(i, f"text {i}", "de", None, None) for i in range(2000, 2009)]  # the last run holds one
    rows += [(3000, "Alone", "fr", "s", 5), (None, "No Id", "en", "s", 5), (3001, None, None, None, None), (3002, "", "", "s", 0), (3003, "x" * 400_000 + "Z", "en", "s", 1)]
    rows += [(5, "Text 5", "en", "s", 5), (5, "Other", "en", "s", 5), (3006, "ÄÉ A\x00ß", "ü", "s", 2), (3009, "Ω", "ü", "s", 1)]
    assert query(spark, rows, tmp_path) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65, 513])
def test_sizes(spark, n, tmp_path):
    rows = [(i, f"A{i}", "en", "s", i) for i in range(n)]
    got = query(spark, rows, tmp_path)
    assert got == brute(rows)
    if n > 1:
        assert {r[-1] for r in got} == {True, False} or n < 8


def test_proofs_are_siblings_and_carry_columns(spark):
    docs = spark.createDataFrame([(i, f"T{i}", "en" if i % 3 else "de", "s", 1, i * 10, "x") for i in range(700)], COLUMNS + ", node long, tree string")
    rows = M.manifest(docs, carry={"node": F.col("node")}).collect()
    assert len(rows) == 700 and all(r.node == r.doc_id * 10 for r in rows)
    for r in rows[:50]:
        h = r.leaf
        for s in r.proof:
            assert len(s.before) % 64 == 0 and len(s.before + s.after) <= 7 * 64
            h = sha(s.before + h + s.after)
        assert h == r.root
    assert len({r.subroot for r in rows}) == 2


def test_only_every_third_level_is_stored(spark):
    leaves = spark.range(5000).select(F.lit("t").alias("tree"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("node"), "id")
    forest = M.build(leaves, ["id"], ["id"])
    assert [b.selectExpr("sum(size(members))").first()[0] for b in forest.stored] == [5000, 10]
    assert forest.stored[0].selectExpr("max(size(members))").first()[0] == M.BLOCK
    plain = reduce([sha(str(i)) for i in range(5000)])
    assert forest.roots.collect()[0].root == plain[-1][0]


def test_many_trees_take_the_plain_join(spark, monkeypatch):
    rows = [(i, f"t{i}", f"l{i % 30}", "s", 1) for i in range(200)]
    monkeypatch.setattr(M, "FEW_TREES", 5)
    got = M.manifest(spark.createDataFrame(rows, COLUMNS)).collect()
    assert {(r.doc_id, r.root) for r in got} == {(r[0], r[3]) for r in brute(rows)}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted([tuple(r) for r in QUERIES["op11_merkle"](spark, SF).collect()], key=repr)
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
