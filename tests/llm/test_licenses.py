import random
import re

import pytest

from histomesh.llm import licenses as L

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    """n_words, n_base, first, last, labels by the plain definition."""
    words = WORD.findall(low(text))
    hits = []
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        own = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def notices(text):
    """Labels of base phrases and notices, by the plain definition."""
    joined = " " + " ".join(WORD.findall(low(text))) + " "
    return {label for phrase, label in {**L.BASE, **L.NOTICES}.items() if f" {phrase} " in joined}


def parse(text):
    """Recursive descent over an expression of known names: what it allows, and its labels."""
    tokens = re.findall(r"[()]|[a-z0-9.-]+", text.lower())
    at = 0

    def atom():
        nonlocal at
        if tokens[at] == "(":
            at += 1
            value = either()
            at += 1
            return value
        label = L.IDENTIFIERS.get(" ".join(re.findall(r"[a-z0-9]+", tokens[at])), "other")
        at += 1
        value = (L.ALLOWS[label], {label})
        if at < len(tokens) and tokens[at] == "with":
            value = (max(value[0], L.EXCEPTIONS.get(" ".join(re.findall(r"[a-z0-9]+", tokens[at + 1])), 0.0)), value[1])
            at += 2
        return value

    def both():
        nonlocal at
        value = atom()
        while at < len(tokens) and tokens[at] == "and":
            at += 1
            other = atom()
            value = (min(value[0], other[0]), value[1] | other[1])
        return value

    def either():
        nonlocal at
        value = both()
        while at < len(tokens) and tokens[at] == "or":
            at += 1
            other = both()
            value = (max(value[0], other[0]), value[1] | other[1])
        return value

    return either()


def find(spark, texts):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    out = L.find(spark.createDataFrame(rows, "doc_id long, text string, labels string, score string")).collect()
    return [r for r in sorted(out, key=lambda r: r.doc_id)]


def one(text):
    import numpy as np

    return L.scan(np.frombuffer(text.encode(), np.uint8), L._automaton())


def test_table_base_part_against_the_plain_definition(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = L.find(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert len(got) == len(docs) and sum(r.n_base for r in got) > 10
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert notices(docs[r.doc_id]) <= set(filter(None, r.labels.split(",")))
        assert (r.score > 0) == bool(r.labels) and 0 <= r.score <= 1
        if not re.search(r"(?i)licen[sc]e", docs[r.doc_id] or ""):
            assert r.labels == "" and r.expressions == "" and r.allows is None


def test_random_texts_against_the_plain_definition(spark):
    rng = random.Random(3)
    pieces = ["mit", "MIT", "license", "License", "apache", "general", "public", "gnu", "lesser", "bsd", "ß", "é", "x1", "İ", "K"]
    gaps = [" ", "  ", "\n", "-", ", ", "\t", "(", ")", "/", "\x00", " "]
    texts = ["".join(rng.choice(pieces) + rng.choice(gaps) for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    for text, r in zip(texts, find(spark, texts)):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), repr(text)
        assert notices(text) <= set(filter(None, r.labels.split(",")))


def test_expressions_against_recursive_descent():
    rng = random.Random(8)
    names = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-or-later", "LGPL-2.1", "BSD-3-Clause", "MPL-2.0", "ISC", "LicenseRef-mine", "CC-BY-NC-4.0"]

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(names)
            return name + (" WITH Classpath-exception-2.0" if rng.random() < 0.2 else "")
        inner = f" {rng.choice(['AND', 'OR', 'and', 'or'])} ".join(make(depth - 1) for _ in range(rng.randrange(1, 4)))
        return f"({inner})" if rng.random() < 0.7 else inner

    for _ in range(300):
        text = make(3)
        got = one(f"// SPDX-License-Identifier: {text}\nand mit")
        allows, labels = parse(text)
        assert got[8] == allows and set(got[5].split(",")) == labels, (text, got)


@pytest.mark.parametrize(
    "text,labels,allows",
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc", 0.2),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl", 0.3),
        ("Dual use: available under the terms of the MIT License or the Apache License, Version 2.0.", "apache,mit", 1.0),
        ("SPDX-License-Identifier: (GPL-2.0-only", "gpl", 0.3),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "gpl", 0.6),
        ("SPDX-License-Identifier: MIT AND", "mit", 1.0),
        ("SPDX-License-Identifier: MIT AND )", "mit", 1.0),
        ("SPDX-License-Identifier: ) OR MIT", "", None),
        ("SPDX-License-Identifier: MIT-0x", "other", 0.0),
        ("SPDX-License-Identifier:\n\nMIT", "", None),
        ("SPDX-License-Identifier: MIT OR (Apache-2.0 AND (BSD-3-Clause", "apache,bsd,mit", 1.0),
        ("licensed under German law, mit freundlichen Grüßen", "", None),
        ("mit mir und mit dir", "", None),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit", None),
        ("Released under the MIT License. Released under GPLv3.", "gpl,mit", 0.3),
    ],
)
def test_statements(text, labels, allows):
    got = one(text)
    assert (got[5], got[8]) == (labels, allows)


def test_edges(spark):
    texts = [None, "", " \n ", "mit license " * 60_000, "MIT LICENSE", "MIT LICENSE", "a" * 300_000, "\x00mit\x00license\x00", "mit licens"]
    got = find(spark, texts)
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [base(t) for t in texts]
    assert got[0].labels == "" and got[0].score == 0 and got[4][1:] == got[5][1:] and got[3].n_base == 60_000
    assert L.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert L.find(spark.createDataFrame([(None, "mit license")], "doc_id long, text string")).first().doc_id is None
