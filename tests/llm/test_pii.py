import hashlib
import random
import re

import pytest

from histomesh.llm import pii

SF = "/root/testdata/sf0.01"
KINDS = ("email", "ip", "card", "phone")
# the four patterns as given, without the shortcuts of the operator
PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for k, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if k == 2:
                total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_base_spans_equal_the_plain_patterns_on_random_strings():
    rng = random.Random(5)
    pieces = ["@", "a", "b.c", "_", "%", ".", "-", "+", "1", "22", "256", "4111111111111111", " ", "(", ")", "\n", "1.2.3.4", "x@y.z", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        data = text.encode()
        points = lambda n: len(data[:n].decode())
        assert [(points(a), k, points(b)) for a, k, b in pii.base_spans(data)] == brute(text), text


def test_long_runs_stay_linear():
    for piece in (b"9" * 300_000, b"a" * 300_000 + b"@", b"+" * 300_000, b"1." * 150_000, b"a@" * 100_000):
        pii.base_spans(piece)


def test_whole_query_against_brute_force(spark):
    from histomesh.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op9_pii"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want, r = brute(d.text), got[d.doc_id]
        assert r.base_sha256 == digest(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert {f"{KINDS[k]}:{a}:{b}" for a, k, b in want} <= set(r.spans.split(","))


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please call hotline +1 (555) 010-{1000 + i} now") for i in range(6)]
    rows += [(10, "ümlaut call hotline 555-0199-77 now"), (11, "the code 555-0199-77 is plain"), (12, "nothing here")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10].spans == "phone:20:31" and got[10].n_phone == 0 and got[10].n_added == 1
    assert got[11].spans == "" and got[12].spans == ""
    assert all(got[i].n_phone == 1 and got[i].n_added == 0 for i in range(6))


def test_second_round_uses_what_the_first_found(spark):
    rows = [(i, f"ring desk +1 (555) 010-{1000 + i} ok") for i in range(8)]
    rows += [(100 + i, f"ring desk 77-00-1{i}5 ok") for i in range(4)] + [(200 + i, f"local ext 77-00-1{i}5 ok") for i in range(4)]
    rows += [(300, "local ext 99-88-777 ok")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {r.doc_id: r.n_added for r in pii.find(docs, rounds=1).collect()}
    later = {r.doc_id: r.n_added for r in pii.find(docs, rounds=3).collect()}
    assert first[100] == 1 and first[200] == 0 and later[200] == 1 and later[300] == 1


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (None, "a@b.cd " * 60_000, None), (1, None, "k")], "doc_id long, text string, kind string")
    rows = sorted(pii.find(docs).collect(), key=lambda r: r.n_email)
    assert [r.n_email for r in rows] == [0, 0, 0, 60_000]
    assert rows[0].spans == "" and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(docs.limit(0)).count() == 0


@pytest.mark.parametrize("digits,ok", [(b"4111111111111111", True), (b"4111111111111112", False), (b"0" * 12, True)])
def test_luhn(digits, ok):
    assert pii.luhn(digits) is ok


def test_copies_leave_a_perfect_context_alone(spark):
    rows = [(100 * i + k, f"write inbox user{i}@mail.org today") for i in range(10) for k in range(20)]
    rows += [(5000, "write inbox user77 at mail 4815162342 today")] + [(6000, "write inbox 4815162342x today")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[6000].spans == "email:12:23" and got[5000].n_added == 0


def test_numbers_in_groups_are_one_candidate(spark):
    rows = [(i, f"please call hotline +1 (555) 010-{1000 + i} now") for i in range(6)]
    rows += [(10, "call hotline 555 123 4567, or 12 now"), (11, "call hotline 12 now"), (12, "plain 555 123 4567")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10].spans == "phone:13:25" and got[11].spans == "" and got[12].spans == ""


def test_contexts_with_too_many_followers_are_marked_and_change_nothing(spark, monkeypatch):
    rows = [(i, f"please call hotline +1 (555) 010-{1000 + i} now and the {2000000 + i} with the w{i} of the x{i}") for i in range(40)]
    rows += [(100 + i, f"call hotline 555-0199-{10 + i} then the y{i} the z{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = pii.durable(pii.extract(docs))
    pruned = {tuple(r) for r in pii.induce(docs, found).collect()}
    marks = []
    plain = pii.followers
    monkeypatch.setattr(pii, "followers", lambda d, s, c: marks.append(plain(d, s, c).filter("head is null").distinct().count()) or plain(d, s, 1e-9))
    assert {tuple(r) for r in pii.induce(docs, found).collect()} == pruned and pruned
    assert marks[0] >= 1
