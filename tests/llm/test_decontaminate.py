import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from histomesh.llm import decontaminate as D
from histomesh.llm.text import buffer_of

SF = "/root/testdata/sf0.01"
EDGE = "\"'()[]{}<>,;:!?.|*#&_`~"


def naive_template(text, names=True):
    """[(kind, token, value)] word by word."""
    out, previous, stop, line = [], None, True, True
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        fresh = stop or "\n" in text[line if isinstance(line, int) and line is not True else 0 : m.start()]
        raw = m[0]
        core = raw.strip(EDGE)
        next_stop, next_line = raw[-1] in ".!?:", m.end()
        if core:
            low = core.lower()
            if core[0] in "0123456789" or (core[0] in "+-$" and core[1:2].isdigit()):
                kind = "num"
            elif previous == "num" and low in D.UNITS:
                kind = "unit"
            elif names and core[0].isupper() and not fresh:
                kind = "name"
            else:
                kind = "lit"
            if kind == "name" and previous == "name":
                out[-1] = (kind, "<name>", out[-1][2] + " " + low)
            else:
                out.append((kind, low if kind == "lit" else f"<{kind}>", low))
            previous = kind
        stop, line = next_stop, next_line
    return out


def naive_windows(tokens, size):
    need = (size + 1) // 2
    return {
        i: (tuple(t for _, t, _ in tokens[i : i + size]), [(k, v) for k, _, v in tokens[i : i + size] if k != "lit"])
        for i in range(len(tokens) - size + 1)
        if sum(k == "lit" for k, _, _ in tokens[i : i + size]) >= need
    }


def naive_contaminated(docs, items, size=8, least=5, coverage=0.5, verbatim=20):
    """{(doc_id, item_id): matched windows of the template that covers more}."""
    out = {}
    for named in (True, False):
        made, bodies = {}, [(doc_id, naive_template(body, named)) for doc_id, body in docs]
        for item_id, text in items:
            tokens = naive_template(text, named)
            width = min(size, len(tokens))
            if width < least:
                continue
            theirs = naive_windows(tokens, width)
            by = defaultdict(list)
            for i, (w, slots) in theirs.items():
                by[w].append((i, slots))
            if width not in made:  # window -> where it stands
                made[width] = defaultdict(list)
                for doc_id, body in bodies:
                    for j, (w, slots) in naive_windows(body, width).items():
                        made[width][w].append((doc_id, j, slots))
            met = defaultdict(lambda: defaultdict(set))
            for w in by:
                for doc_id, j, slots in made[width].get(w, []):
                    for i, own in by[w]:
                        met[doc_id][j - i].add((i, tuple(zip([v for _, v in own], [v for _, v in slots]))))
            for doc_id, shifts in met.items():
                places, most = set(), 0
                for got in shifts.values():
                    votes = Counter(p for _, pairs in got for p in pairs)
                    top = {}
                    for (a, b), n in votes.items():
                        top[a] = max(top.get(a, (0, False)), (n, a == b))
                    tied = Counter(a for (a, b), n in votes.items() if (n, a == b) == top[a])
                    if any(tied[a] > 1 for a in tied):
                        places = None  # decided by hashes, which this test doesn't know
                        break
                    good = {p for p, n in votes.items() if (n, p[0] == p[1]) == top[p[0]]}
                    places |= {i for i, pairs in got if all(p[0] == p[1] or p in good for p in pairs)}
                    most = max(most, len({i for i, pairs in got if all(x == y for x, y in pairs)}))
                if places is None:
                    out[doc_id, item_id] = None
                elif theirs and (len(places) / len(theirs) >= coverage or most >= verbatim):
                    share = (len(places) / len(theirs), named, len(places))
                    if out.get((doc_id, item_id), ()) is not None:
                        out[doc_id, item_id] = max(out.get((doc_id, item_id), share), share)
    return {k: v and v[2] for k, v in out.items()}


def test_template_tokens():
    text = 'In Paris, Mary Ann bought 12 apples for 3.50 euros. Then she ran -7 km (fast)! 5km\nBob "saw" Öland'
    rows, kinds, tokens, values = D.template(*buffer_of(pa.array([text])))
    assert kinds.tolist() == [{"lit": 0, "num": 1, "name": 2, "unit": 3}[k] for k, _, _ in naive_template(text)]
    assert [k for k, _, _ in naive_template(text)].count("name") == 2  # Paris, Mary and Ann are neighbours


@pytest.mark.parametrize("size", [8, 6])
def test_query_against_brute_force(spark, size):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.matched for r in D.contaminated(docs, items, size=size).collect()}
    want = naive_contaminated([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], size)
    tied = {k for k, v in want.items() if v is None}
    assert {k: v for k, v in got.items() if k not in tied} == {k: v for k, v in want.items() if k not in tied}
    assert len(got) > 10 and len(tied) < 0.1 * len(got)


ITEM = "If Anna has 12 apples and gives 5 apples to her brother Tom then how many apples does Anna still have after that day of 12 hours"


def run(spark, texts, items=((1, ITEM, "en"),)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = D.contaminated(docs, spark.createDataFrame(list(items), "item_id long, text string, doc_id string"))
    return {r.doc_id: r for r in got.collect()}


def test_changed_parameters_are_caught_and_other_texts_are_not(spark):
    same = "before it. " + ITEM + " and after"
    changed = ITEM.replace("Anna", "Zoe").replace("12", "31").replace("Tom", "Ben").replace(" 5 ", " 8 ")
    mixed = " ".join(w if i % 4 else "other" for i, w in enumerate(ITEM.split()))
    got = run(spark, [same, changed, mixed, "unrelated words only here and there and everywhere again"])
    assert set(got) == {0, 1}
    assert not got[0].reparameterised and got[1].reparameterised and got[1].slots_changed >= 3


def test_one_conflicting_slot_leaves_the_other_windows(spark):
    twice = ("a farmer keeps 40 sheep on a hill and buys some more at the market so that in the end there are 40 sheep "
             "in the barn and nobody knows how many of them are white or black at all")
    broken = twice.replace("40", "41", 1)
    got = run(spark, [broken, twice.replace("40", "17")], ((1, twice, "x"),))
    assert set(got) == {0, 1} and got[0].coverage >= 0.5 and got[1].coverage == 1.0 and got[1].reparameterised


def test_letter_case_and_blanks_do_not_hide_a_copy(spark):
    names = "On monday the teacher asked Anna Maria Berg and Tom Lee to count all the books that Anna Maria Berg keeps in the school of Old Town"
    got = run(spark, [ITEM.upper(), ITEM.lower(), names.lower(), names.upper(), names.replace("Anna Maria", "Anna  Maria", 1)], ((1, ITEM, "x"), (2, names, "x")))
    assert set(got) == {0, 1, 2, 3, 4} and got[0].coverage == got[3].coverage == got[4].coverage == 1.0


def test_a_long_verbatim_run_counts_whatever_the_coverage(spark):
    long = " ".join(f"word{i}" for i in range(200))
    got = run(spark, [" ".join(f"word{i}" for i in range(50, 77)), " ".join(f"word{i}" for i in range(50, 76))], ((1, long, "x"),))
    assert set(got) == {0} and got[0].verbatim == 20 and got[0].coverage < 0.5


def test_short_items_and_edges(spark):
    items = [(1, "alpha beta gamma delta epsilon", "x"), (2, "too short", "x"), (3, None, "x"), (4, "", None), (1, "alpha beta gamma delta epsilon", "x")]
    got = run(spark, ["we saw alpha beta gamma delta epsilon today", None, "", "word " * 200_000, "alpha beta gamma"], items)
    assert set(got) == {0} and got[0].coverage == 1.0
    assert run(spark, [], items) == {} and run(spark, ["a"], items[1:3]) == {}


def test_clean_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (2, "free text", "b"), (2, "free text", "b"), (None, None, "c"), (None, ITEM, "d")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == ["b", "b"]


def test_bloom_filter_has_no_false_negatives(spark):
    values = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    bloom = D.bloom_filter(spark.createDataFrame([(int(v),) for v in values], "window long"))
    assert D._maybe(bloom, values.view(np.uint64)).all()
    assert D._maybe(bloom, np.random.default_rng(2).integers(0, 1 << 62, 20000).view(np.uint64)).mean() < 0.02
