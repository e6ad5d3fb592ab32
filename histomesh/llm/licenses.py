"""Licence statements in texts.

One Aho-Corasick automaton walks every text, reduced to lower-case words one blank apart, and finds
licence notices and the tags that introduce an expression (``SPDX-License-Identifier:``, ``licensed under``).
Behind a tag, identifiers, ``and``, ``or``, ``with`` and brackets are read from the text; a
shunting-yard parser puts them into postfix order, and the evaluation gives the licences named and how
much the statement allows: all of ``and``, the best of ``or``, an exception may widen a licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that count as base places, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label -> how much the licence allows (1: nearly everything, 0: nothing).
ALLOWS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "boost": 1.0, "unlicense": 1.0, "cc0": 1.0, "wtfpl": 1.0,
    "cc-by": 0.9, "artistic": 0.8, "mpl": 0.6, "epl": 0.6, "cddl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "eupl": 0.4, "gpl": 0.3, "agpl": 0.2,
    "cc-by-nc": 0.2, "cc-by-nd": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "other": 0.0,
}

# Names of licences as words; versions and their suffixes are added by rule.
NAMES = {
    "mit": ("mit", "mit license", "mit licence", "expat", "x11"),
    "apache": ("apache", "apache license", "apache licence"),
    "bsd": ("bsd", "0bsd", "bsd license", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause"),
    "isc": ("isc", "isc license"),
    "zlib": ("zlib", "zlib license"),
    "boost": ("bsl", "boost software license"),
    "unlicense": ("unlicense",),
    "cc0": ("cc0", "creative commons zero"),
    "wtfpl": ("wtfpl",),
    "cc-by": ("cc by", "creative commons attribution"),
    "cc-by-sa": ("cc by sa", "creative commons attribution sharealike"),
    "cc-by-nc": ("cc by nc", "creative commons attribution noncommercial"),
    "cc-by-nd": ("cc by nd", "creative commons attribution noderivatives"),
    "cc-by-nc-sa": ("cc by nc sa", "creative commons attribution noncommercial sharealike"),
    "cc-by-nc-nd": ("cc by nc nd", "creative commons attribution noncommercial noderivatives"),
    "artistic": ("artistic", "artistic license"),
    "mpl": ("mpl", "mozilla public license"),
    "epl": ("epl", "eclipse public license"),
    "cddl": ("cddl", "common development and distribution license"),
    "eupl": ("eupl", "european union public license"),
    "gpl": ("gpl", "gnu gpl", "gnu general public license", "general public license"),
    "lgpl": ("lgpl", "gnu lgpl", "gnu lesser general public license", "gnu library general public license"),
    "agpl": ("agpl", "gnu agpl", "gnu affero general public license"),
}
VERSIONS = ("1", "1 0", "1 1", "1 2", "2", "2 0", "2 1", "2 5", "3", "3 0", "4 0")
SUFFIXES = ("", " only", " or later", " or any later version")

# Wording of notices that stand without a tag.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
}
SPDX = "spdx license identifier"
TAGS = (SPDX, "licensed under", "license under", "released under", "distributed under", "available under")
FILLERS = frozenset(("the", "a", "an", "either", "terms", "conditions", "of", "following", "both"))
# Exceptions that widen what a licence allows.
EXCEPTIONS = {"classpath exception 2 0": 0.6, "gcc exception 3 1": 0.6, "linux syscall note": 0.6, "llvm exception": 1.0, "autoconf exception 3 0": 0.6, "font exception 2 0": 0.6}

#: How sure a statement of either kind makes a label.
CERTAINTY = {"base": 0.6, "notice": 0.8, "expression": 0.9}
RESULT = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, expressions string, allows double"
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_FOLD = np.full(256, 32, np.uint8)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        _FOLD[_b] = _b
    elif 65 <= _b <= 90:
        _FOLD[_b] = _b + 32
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xFF]+|[()]")


def _identifiers() -> dict[str, str]:
    out = {}
    for label, names in NAMES.items():
        for name in names:
            out[name] = label
            for v in VERSIONS:
                for joint in (f"{name} {v}", f"{name} v{v}", f"{name} version {v}", *((f"{name}{v}", f"{name}v{v}") if " " not in name else ())):
                    for suffix in SUFFIXES:
                        out[joint + suffix] = label
    return out


IDENTIFIERS = _identifiers()
LONGEST = max(len(x.split()) for x in (*IDENTIFIERS, *EXCEPTIONS))


def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list] = {}
    for phrase, label in BASE.items():
        found.setdefault(phrase, []).append(("base", label))
    for phrase, label in NOTICES.items():
        found.setdefault(phrase, []).append(("notice", label))
    for phrase in TAGS:
        found.setdefault(phrase, []).append(("tag", phrase))
    out = ahocorasick.Automaton()
    for phrase, uses in found.items():
        out.add_word(f" {phrase} ", (len(phrase), tuple(uses)))
    out.make_automaton()
    return out


def normalised(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a text, one blank around each, and which bytes of ``blank + text + blank`` they come from."""
    spaced = np.full(len(data) + 2, 32, np.uint8)
    spaced[1:-1] = _FOLD[data]
    keep = np.ones(len(spaced), bool)
    keep[1:] = (spaced[1:] != 32) | (spaced[:-1] != 32)
    return spaced[keep], keep


class _Tokens:
    """Words and brackets of a text from an offset on, read as far as asked for; a blank line ends them, or
    any line's end if they are to be on ``one_line``."""

    def __init__(self, data: bytes, at: int, one_line: bool):
        self.data, self.found, self.held, self.last = data, _TOKEN.finditer(data, at), [], at
        self.end = b"\n" if one_line else b"\n\n"

    def peek(self, k: int) -> tuple[str, int, int] | None:
        while len(self.held) <= k:
            m = next(self.found, None)
            if m is None or self.data[self.last : m.start()].replace(b"\r", b"").replace(b" ", b"").count(self.end):
                self.found = iter(())
                return None
            self.held.append((m[0].lower().decode("utf-8", "replace"), m.start(), m.end()))
            self.last = m.end()
        return self.held[k]

    def skip(self, k: int) -> None:
        del self.held[:k]

    def longest(self, table: dict) -> tuple[str, int] | None:
        """The longest entry of ``table`` that the next words spell, and its number of words."""
        words: list[str] = []
        for k in range(LONGEST):
            token = self.peek(k)
            if token is None or token[0] in "()":
                break
            words.append(token[0])
        for k in range(len(words), 0, -1):
            if (name := " ".join(words[:k])) in table:
                return name, k
        return None

    def compound(self) -> tuple[str, int] | None:
        """The next words that only ``-``, ``.``, ``+`` or ``_`` join: an identifier as written."""
        token = self.peek(0)
        if token is None or token[0] in "()" or token[0] in PRECEDENCE:
            return None
        k, end = 1, token[2]
        while (after := self.peek(k)) is not None and 0 < after[1] - end and not self.data[end : after[1]].strip(b"-.+_"):
            k, end = k + 1, after[2]
        return " ".join(self.peek(i)[0] for i in range(k)), k


def read_expression(data: bytes, at: int, strict: bool) -> list[tuple[str, str]]:
    """(kind, value) tokens of the expression at an offset, well-formed; empty if there is none.

    ``strict``: behind an SPDX tag, where names that aren't known are licences too and a line's end is the end.
    """
    tokens, out, depth, operand = _Tokens(data, at, strict), [], 0, True
    if not strict:
        while (t := tokens.peek(0)) is not None and t[0] in FILLERS:
            tokens.skip(1)
    kept, kept_depth = 0, 0  # how much of ``out`` ends in a whole operand, and how many brackets are open there
    while (t := tokens.peek(0)) is not None:
        word = t[0]
        if operand:
            if word == "(" and out[-1:] != [("op", "with")]:
                out.append(("(", ""))
                depth += 1
                tokens.skip(1)
                continue
            table = EXCEPTIONS if out and out[-1] == ("op", "with") else IDENTIFIERS
            hit = tokens.longest(table)
            written = tokens.compound() if strict else None
            if written and (hit is None or hit[1] < written[1]):
                hit = written
            if hit is None:
                break
            out.append(("exception" if table is EXCEPTIONS else "licence", hit[0]))
            tokens.skip(hit[1])
            operand, kept, kept_depth = False, len(out), depth
        elif word == ")" and depth:
            out.append((")", ""))
            depth -= 1
            tokens.skip(1)
            kept, kept_depth = len(out), depth
        elif word in PRECEDENCE:
            if word == "with" and out[-1][0] != "licence":
                break
            out.append(("op", word))
            tokens.skip(1)
            operand = True
        else:
            break
    return out[:kept] + [(")", "")] * kept_depth


def postfix(tokens: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Shunting-yard: operands and operators in postfix order; ``with`` binds closest, then ``and``, then ``or``."""
    out, stack = [], []
    for kind, value in tokens:
        if kind in ("licence", "exception"):
            out.append((kind, value))
        elif kind == "(":
            stack.append((kind, value))
        elif kind == ")":
            while stack[-1][0] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            while stack and stack[-1][0] == "op" and PRECEDENCE[stack[-1][1]] >= PRECEDENCE[value]:
                out.append(stack.pop())
            stack.append((kind, value))
    return out + stack[::-1]


def evaluate(tokens: list[tuple[str, str]]) -> tuple[float, frozenset[str], str]:
    """What the expression allows, the labels in it, and the expression with all its brackets."""
    stack: list[tuple[float, frozenset[str], str]] = []
    for kind, value in postfix(tokens):
        if kind == "licence":
            label = IDENTIFIERS.get(value, "other")
            stack.append((ALLOWS[label], frozenset((label,)), value))
        elif kind == "exception":
            stack.append((EXCEPTIONS.get(value, 0.0), frozenset(), value))
        else:
            right, left = stack.pop(), stack.pop()
            allows = min(left[0], right[0]) if value == "and" else max(left[0], right[0])
            stack.append((allows, left[1] | right[1], f"({left[2]} {value.upper()} {right[2]})"))
    return stack[0]


def scan(data: np.ndarray, automaton: ahocorasick.Automaton) -> tuple:
    """The result columns behind doc_id for one text's UTF-8 bytes."""
    words, keep = normalised(data)
    n_words = int((words == 32).sum()) - 1
    base, labels, sure, statements = [], set(), {}, []
    hits = [(end - size, use) for end, (size, uses) in automaton.iter(words.tobytes().decode("latin-1")) for use in uses] if n_words > 0 else []
    if hits:
        blanks = np.flatnonzero(words == 32)
        raw, text = None, b""
        for at, (kind, value) in hits:  # at: of the first letter
            if kind == "base":
                base.append((int(np.searchsorted(blanks, at)) - 1, value))
            if kind != "tag":
                labels.add(value)
                sure[value] = max(sure.get(value, 0.0), CERTAINTY[kind])
                continue
            if raw is None:
                raw, text = np.flatnonzero(keep), data.tobytes()
            behind = int(raw[at + len(value) - 1])  # one blank stands before the text
            tokens = read_expression(text, behind, value == SPDX)
            if tokens:
                allows, named, written = evaluate(tokens)
                statements.append((allows, written))
                for label in named:
                    labels.add(label)
                    sure[label] = CERTAINTY["expression"]
    doubt = 1.0
    for label in sorted(sure):
        doubt *= 1.0 - sure[label]
    places = [w for w, _ in base]
    return (
        n_words, len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)),
        1.0 - doubt if sure else 0.0, "; ".join(x for _, x in statements), min((a for a, _ in statements), default=None),
    )


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), whole texts.

    Words are runs of digits, letters and characters beyond ASCII, A-Z as a-z. n_base, first_word, last_word and
    base_labels tell of the places of the three base phrases; ``labels`` adds those of notices and of
    expressions, ``expressions`` lists the latter in text order, ``allows`` is the least that one of them
    grants (null without any). ``score``: how surely the text carries a licence, a noisy-or over labels. A
    null or empty text has no words, empty lists and a score of 0; repeated rows give repeated results;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64()]
        for batch in batches:
            column = batch.column(1).cast(pa.large_string())
            _, offsets, buffer = column.buffers()
            at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
            data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            rows = [scan(data[a:b] if ok else data[:0], automaton) for a, b, ok in zip(at[:-1], at[1:], valid)]
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], [f.split()[0] for f in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)
