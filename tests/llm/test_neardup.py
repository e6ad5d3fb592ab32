import random
import re

import numpy as np

from histomesh.llm import neardup as N
from histomesh.llm.graph import components

SF = "/root/testdata/sf0.001"


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(docs, size, threshold=80):
    """{doc_id: (n, component)} by comparing all pairs; rows of one id are linked."""
    sets = [(d, shingle_set(t, size)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and (x == y or 100 * len(x & y) >= threshold * len(x | y)):
                a_, b_ = root(a), root(b)
                parent[max(a_, b_)] = min(a_, b_)
    return [(d, len(s), root(d)) for d, s in sets]


def run(spark, docs, size=5):
    frame = spark.createDataFrame(docs, "doc_id long, text string") if docs else spark.createDataFrame([], "doc_id long, text string")
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(frame, size).collect()], key=repr)


def test_table_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for size in (2, 5):
        assert run(spark, docs, size) == sorted(brute(docs, size), key=repr)


def test_crowd_of_near_copies_and_chains(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):  # a crowd: every copy has its own two changed words
        own = list(base)
        for _ in range(2):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(40):  # a chain: only neighbours are similar
        docs.append((1000 + i, " ".join(chain)))
        chain = chain[4:] + [f"c{100 + 4 * i + k}" for k in range(4)]
    got = run(spark, docs, 2)
    assert got == sorted(brute(docs, 2), key=repr)
    assert {c for d, _, c in got if d >= 1000} == {1000}


def test_edge_rows(spark):
    long_text = "long words here " * 60_000
    docs = [(5, None), (4, ""), (3, " \n\t"), (9, "One"), (8, "one"), (7, "one two"), (6, "ÉTÉ"), (2, "été"), (20, long_text), (21, long_text + "end"), (9, "One")]
    got = run(spark, docs, 2)
    assert got == sorted(brute(docs, 2), key=repr)
    assert (9, 1, 8) in got and (2, 1, 2) in got and (6, 1, 6) in got and (4, 0, 4) in got
    assert run(spark, []) == []


def test_null_ids_shared_ids_and_other_columns(spark):
    rows = [(None, "a b c d", 1), (1, "a b c d", 2), (2, "p q r s", 3), (2, "a b c d", 4), (3, "p q r s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted([(r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(docs, 2).collect()], key=repr)
    assert got == sorted([(None, None, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False)], key=repr)


def test_regions_split_crowds_and_keep_small_ones_whole():
    deep, shallow = N.DEPTH, N.SHALLOWEST
    lcp = np.array([shallow] * 3 + [0] + [deep] * 100 + [shallow] + [deep] * 5)
    first, last = N.regions(lcp)
    got = sorted(zip(first.tolist(), last.tolist()))
    assert got[0] == (0, 3) and all(b - a < N.CROWD for a, b in got)
    assert {i for a, b in got for i in range(a, b + 1)} == set(range(len(lcp) + 1))
    joined = set()
    for a, b in got[1:]:
        joined |= {(i, i + 1) for i in range(a, b)}
    assert {(i, i + 1) for i in range(4, 104)} <= joined


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    a, b = np.sort(pool[:900]), np.sort(pool[100:])
    s = N.signatures(np.repeat([0, 1], [900, 900]), np.concatenate([a, b]))
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12


def test_components_of_paths_stars_and_none(spark):
    path = [(i, i + 1) for i in range(100, 260)]
    star = [(7, i) for i in range(1000, 1200)]
    edges = spark.createDataFrame(path + star + [(5, 5), (50, 40), (40, 50)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert {got[i] for i in range(100, 261)} == {100} and {got[i] for i in range(1000, 1200)} == {7} and got[50] == 40
    assert components(edges.limit(0)).count() == 0


def test_parity_maps_bound_the_difference():
    rng = np.random.default_rng(3)
    for size, change in ((50, 3), (400, 40), (20, 20)):
        a = rng.integers(0, 1 << 63, size).astype(np.uint64)
        b = np.concatenate([a[change:], rng.integers(0, 1 << 63, change).astype(np.uint64)])
        x, y = N.parity_maps(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_links_inside_a_template_family_are_all_found(spark):
    base = [f"t{i}" for i in range(300)]
    docs, want = [], {}
    for i in range(500):  # fillings share 0.75 of the template; only the two texts of one filling reach 0.8
        filled = base[:60] + [f"f{i}_{k}" for k in range(42)] + base[102:]
        other = 1000 + (i * 83) % 500
        docs += [(i, " ".join(filled)), (other, " ".join(filled[:150] + [f"g{i}_{k}" for k in range(31)] + filled[181:]))]
        want |= {i: i, other: i}
    assert {d: c for d, _, c in run(spark, docs, 2)} == want


def test_rows_of_split_and_cut_regions_are_uncertain():
    shallow = N.SHALLOWEST
    lcp = np.array([shallow] * 3 + [0] + [shallow] * (N.CROWD + 1) + [0] + [shallow] * 5 + [0, shallow])
    got = set(N.uncertain(lcp).tolist())
    crowd = set(range(4, 6 + N.CROWD))
    assert got == set(range(4)) | crowd | {len(lcp) - 1, len(lcp)}
