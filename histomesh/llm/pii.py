"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

The fixed patterns give base spans (email, ip, card, phone). Their values are seeds of a graph
between lexical patterns (the word or the two words before an identifier) and instances (the
identifier-like tokens that follow). Spark scores it in rounds: a pattern's confidence is the
number of its known instances over all different things that follow its words in the corpus, so that
copies of a passage change neither side; an unknown
instance's score is the noisy-or of its patterns; instances that score high are known in the next
round. In the end, high-confidence patterns mark the unknown identifier-like tokens behind them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.llm.decontaminate import _maybe, bloom_filter
from histomesh.llm.text import blocks, buffer_of, mix, words
from histomesh.session import durable, release

BOUNDS = 1 << 20
KINDS = ("email", "ip", "card", "phone")
EMAIL_TAIL = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT_GROUP = re.compile(rb"[(]?[0-9][0-9().-]*+")
TOKEN_EDGE = b"\"'()[]{}<>,;:!?|%$&*#.="
HAS_MARK = np.zeros(256, bool)
HAS_MARK[[*range(48, 58), ord("@")]] = True
FOUND = "doc_id bigint, base array<struct<kind:int,start:int,end:int>>, candidates array<struct<kind:int,start:int,end:int,one:bigint,two:bigint,head:bigint,instance:bigint>>"
RESULT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(data: bytes) -> Iterator[tuple[int, int]]:
    done, at = 0, data.find(b"@")
    while at >= 0:
        tail = EMAIL_TAIL.match(data, at)
        local = at
        while local > done and data[local - 1] in _LOCAL_BYTES:
            local -= 1
        if tail and local < at:
            yield local, tail.end()
            done = tail.end()
            at = data.find(b"@", done)
        else:
            done = at + 1
            at = data.find(b"@", at + 1)


_LOCAL_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS_ONLY = bytes(b for b in range(256) if not 48 <= b <= 57)


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, sorted; leftmost non-overlapping matches of each kind that pass its test."""
    out = [(a, 0, b) for a, b in _emails(data)] if b"@" in data else []
    for m in IP.finditer(data):
        if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(data):
        digits = m[0].translate(None, _DIGITS_ONLY)
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if b"+" in data:
        for m in PHONE.finditer(data):
            if 9 <= len(m[0].translate(None, _DIGITS_ONLY)) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _contexts(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and of it with the word before it in the row (0 if there is none)."""
    two = np.zeros(len(hashes), np.uint64)
    if len(hashes) > 1:
        two[1:] = np.where(rows[1:] == rows[:-1], mix(hashes[:-1] * np.uint64(3) + hashes[1:]), np.uint64(0))
    return _signed(hashes), _signed(two)


def _identifier(token: bytes, least_digits: int) -> tuple[int, int] | None:
    """Bounds of an identifier-like core: as many digits as asked for, or an @ between other characters."""
    a, b = 0, len(token)
    while a < b and token[a] in TOKEN_EDGE:
        a += 1
    while b > a and token[b - 1] in TOKEN_EDGE:
        b -= 1
    core = token[a:b]
    if len(core.translate(None, _DIGITS_ONLY)) >= least_digits or b"@" in core[1:-1]:
        return a, b
    return None


def _grouped(data: bytes, starts: np.ndarray, ends: np.ndarray, least_digits: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring digit groups, one blank apart, none of which has ``least_digits`` itself."""
    run: list[tuple[int, int]] = []

    def close() -> Iterator[tuple[int, int]]:
        if len(run) > 1:
            a, b = run[0][0], run[-1][0] + len(data[run[-1][0] : run[-1][1]].rstrip(TOKEN_EDGE + b"-"))
            if len(data[a:b].translate(None, _DIGITS_ONLY)) >= least_digits:
                yield a, b
        run.clear()

    for a, b in zip(starts.tolist(), ends.tolist()):
        token = data[a:b]
        fits = DIGIT_GROUP.fullmatch(token.rstrip(b",;:!?\"'")) and len(token.translate(None, _DIGITS_ONLY)) < least_digits
        if not fits or (run and (a != run[-1][1] + 1 or data[a - 1] not in b" \t")):
            yield from close()
        if fits:
            run.append((a, b))
            if token[-1] in b".,;:!?\"'":
                yield from close()
    yield from close()


def extract(docs: DataFrame, least_digits: int = 5) -> DataFrame:
    """Per row: base spans and candidates in code points. A candidate is a base span, or an
    identifier-like token or run of digit groups (kind -1) that no base span touches, with hashes of the
    words before it and of the word it begins in (head)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffer, offsets = buffer_of(batch.column(1))
            base_out, candidate_out = [], []
            for a, b in blocks(offsets, 1 << 20):
                part, at = buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                marks = np.r_[0, np.cumsum(HAS_MARK[part])]
                marked = marks[at[1:]] > marks[at[:-1]]
                rows, starts, ends, hashes = words(part, at)
                one, two = _contexts(hashes, rows)
                firsts = np.searchsorted(rows, np.arange(b - a + 1))
                for i in range(b - a):
                    if not marked[i]:
                        base_out.append([])
                        candidate_out.append([])
                        continue
                    data = part[at[i] : at[i + 1]].tobytes()
                    base = base_spans(data)
                    f, g = firsts[i], firsts[i + 1]
                    s, e = starts[f:g] - at[i], ends[f:g] - at[i]
                    found = [(kind, x, y) for x, kind, y in base]
                    taken = np.zeros(len(data) + 1, np.int32)
                    for x, _, y in base:
                        taken[x] += 1
                        taken[y] -= 1
                    taken = np.cumsum(taken)
                    some = np.flatnonzero(marks[at[i] + e] > marks[at[i] + s])
                    found += [(-1, x, y) for x, y in _grouped(data, s[some], e[some], least_digits) if not taken[x:y].any()]
                    for k in some:
                        core = _identifier(data[s[k] : e[k]], least_digits)
                        if core and not taken[s[k] + core[0] : s[k] + core[1]].any():
                            found.append((-1, int(s[k]) + core[0], int(s[k]) + core[1]))
                    points = np.r_[0, np.cumsum((part[at[i] : at[i + 1]] & 0xC0) != 0x80)]
                    base_out.append([{"kind": kind, "start": int(points[x]), "end": int(points[y])} for x, kind, y in base])
                    listed = []
                    for kind, x, y in found:
                        before = int(np.searchsorted(e, x, "right")) - 1  # the last word that ends before it
                        instance = int.from_bytes(hashlib.blake2b(data[x:y], digest_size=8).digest(), "big", signed=True)
                        listed.append({"kind": kind, "start": int(points[x]), "end": int(points[y]), "one": int(one[f + before]) if before >= 0 else 0, "two": int(two[f + before]) if before >= 0 else 0, "head": int(one[f + before + 1]), "instance": instance})
                    candidate_out.append(listed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base_out, _BASE), pa.array(candidate_out, _CANDIDATES)], ["doc_id", "base", "candidates"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


_BASE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_CANDIDATES = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("one", pa.int64()), ("two", pa.int64()), ("head", pa.int64()), ("instance", pa.int64())]))


class _Followers:
    """Different (context, head) pairs of one task. A context with more heads than its bound is out:
    its pairs go, and one mark says so."""

    def __init__(self, bounds: np.ndarray):
        self.bounds, self.pairs, self.fresh, self.waiting = bounds, np.zeros((0, 2), np.int64), [], 0
        self.out = np.zeros(0, np.int64)

    def add(self, context: np.ndarray, head: np.ndarray) -> None:
        if len(self.out):
            at = np.minimum(np.searchsorted(self.out, context), len(self.out) - 1)
            live = self.out[at] != context
            context, head = context[live], head[live]
        if len(context):
            self.fresh.append(np.unique(np.stack([context, head], 1), axis=0))
            self.waiting += len(self.fresh[-1])
        if self.waiting > max(len(self.pairs), 1 << 18):
            self.settle()

    def settle(self) -> None:
        if self.fresh:
            self.pairs = np.unique(np.concatenate([self.pairs, *self.fresh]), axis=0)
            self.fresh, self.waiting = [], 0
            context, count = np.unique(self.pairs[:, 0], return_counts=True)
            over = context[count > self.bounds[(context & (len(self.bounds) - 1)).astype(np.int64)]]
            if len(over):
                self.out = np.union1d(self.out, over)
                self.pairs = self.pairs[~np.isin(self.pairs[:, 0], over)]

    def rows(self, marks: bool) -> pa.RecordBatch:
        out = self.out if marks else self.out[:0]
        context = pa.array(np.r_[self.pairs[:, 0], out])
        head = pa.concat_arrays([pa.array(self.pairs[:, 1].copy()), pa.nulls(len(out), pa.int64())])
        self.pairs = self.pairs[:0]
        return pa.RecordBatch.from_arrays([context, head], ["context", "head"])


def followers(docs: DataFrame, support: DataFrame, least_confidence: float) -> DataFrame:
    """(context, head), distinct: the words that stand behind the contexts of ``support`` (context, n) anywhere
    in the corpus. A null head marks a context with more than ``n / least_confidence`` different ones.

    A confidence is at most n over the number of different heads, so a marked context can't reach
    ``least_confidence``, whatever its other heads. Tasks count up to the largest bound in a context's
    hash bucket; a filter of bounded size thins the pairs inside the scan; the join with all
    contexts is exact.
    """
    context = docs.sparkSession.sparkContext
    bloom = context.broadcast(bloom_filter(support.select(F.col("context").alias("window"))))  # of bounded size
    bucket = F.col("context").bitwiseAND(F.lit(BOUNDS - 1))
    most = support.groupBy(bucket.alias("bucket")).agg(F.max("n").alias("n")).toArrow()  # BOUNDS rows at most
    bounds = np.zeros(BOUNDS, np.int64)
    bounds[most.column("bucket").to_numpy()] = np.floor(most.column("n").to_numpy() / least_confidence + 1e-9).astype(np.int64)
    shared = context.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = bloom.value, _Followers(shared.value)
        for batch in batches:
            buffer, offsets = buffer_of(batch.column(0))
            for a, b in blocks(offsets, 1 << 20):
                rows, _, _, hashes = words(buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(rows) < 2:
                    continue
                inside = rows[1:] == rows[:-1]
                for values in _contexts(hashes, rows):
                    at = np.flatnonzero(inside & (values[:-1] != 0))
                    at = at[_maybe(own, values[at].view(np.uint64))]
                    found.add(values[at], _signed(hashes)[at + 1])
                if len(found.pairs) > 1 << 22:  # bounded memory; what is out stays out
                    found.settle()
                    yield found.rows(False)
        found.settle()
        yield found.rows(True)

    texts = docs.select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "context bigint, head bigint").distinct().join(support.select("context"), "context", "left_semi")


def induce(docs: DataFrame, found: DataFrame, rounds: int = 3, least_instances: int = 3, least_confidence: float = 0.5, least_score: float = 0.7) -> DataFrame | None:
    """High-confidence patterns (context, kind, confidence), from ``rounds`` over the graph; None if no
    context has ``least_instances`` different instances.

    What follows a context counts once however often it stands there: a candidate by its text, any
    other word by itself. A confidence is at most 0.999, so that no single pattern makes a certainty.
    """
    c = F.explode("candidates").alias("c")
    edges = durable(
        found.select(c)
        .select("c.kind", "c.instance", "c.head", F.explode(F.array("c.one", "c.two")).alias("context"))
        .filter("context <> 0")
        .groupBy("context", "instance")
        .agg(F.max("kind").alias("kind"), F.min("head").alias("head"))
    )
    support = durable(edges.groupBy("context").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_instances))
    if support.isEmpty():
        return None
    behind = durable(followers(docs, support, least_confidence))
    known = durable(edges.filter("kind >= 0").join(support.select("context"), "context", "left_semi").select("instance", "kind").distinct())
    whole, every, support = edges, support, durable(support.join(behind.filter("head is null").select("context").distinct(), "context", "left_anti"))
    plain = behind.filter("head is not null").join(support.select("context"), "context", "left_semi").join(edges.select("context", "head").distinct(), ["context", "head"], "left_anti")
    plain = plain.groupBy("context").agg(F.count(F.lit(1)).alias("plain"))
    totals = support.join(plain, "context", "left").select("context", (F.col("n") + F.coalesce("plain", F.lit(0))).alias("places"))
    edges = durable(edges.drop("head").join(totals, "context"))
    release(behind, every, support, whole)
    patterns = None
    for step in range(rounds):
        hits = edges.drop("kind").join(known, "instance").groupBy("context", "kind").agg(F.count(F.lit(1)).alias("hits"), F.max("places").alias("places"))
        confidence = F.least(F.col("hits") / F.col("places"), F.lit(0.999))
        patterns = durable(
            hits.withColumn("confidence", confidence)
            .filter((F.col("hits") >= least_instances) & (F.col("confidence") >= least_confidence))
            .select("context", "kind", "confidence")
        )
        if step == rounds - 1 or patterns.isEmpty():
            break
        scored = edges.filter("kind < 0").select("context", "instance").join(patterns, "context")
        scored = scored.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        known = durable(known.unionByName(scored.filter(F.col("score") >= least_score).select("instance", "kind")).distinct())
    return patterns


def render(found: DataFrame, patterns: DataFrame | None) -> DataFrame:
    """Counts, digest and span list of every row; base spans stay, pattern spans are added."""
    listed = "array<struct<place:int,kind:int>>"
    if patterns is None:
        found = found.withColumn("marked", F.lit(None).cast(listed))
    else:
        best = patterns.groupBy("context").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b")).select("context", (-F.col("b.k")).alias("_kind"))
        each = found.select("_row", F.posexplode("candidates").alias("place", "c")).filter("c.kind < 0")
        each = each.select("_row", "place", F.posexplode(F.array("c.two", "c.one")).alias("words", "context")).join(best, "context")  # two words go first
        each = each.groupBy("_row", "place").agg(F.min(F.struct("words", F.col("_kind").alias("kind"))).alias("m"))
        marked = each.groupBy("_row").agg(F.collect_list(F.struct("place", F.col("m.kind").alias("kind"))).alias("marked"))
        found = found.join(marked, "_row", "left")
    found = found.select("doc_id", "base", "candidates", "marked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                base = [(s["start"], s["kind"], s["end"]) for s in row["base"]]
                added = [(row["candidates"][m["place"]]["start"], m["kind"], row["candidates"][m["place"]]["end"]) for m in row["marked"] or []]
                counts = np.bincount([k for _, k, _ in base], minlength=4).tolist()
                text = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(base))
                every = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + added))
                out.append((row["doc_id"], *counts, hashlib.sha256(text.encode()).hexdigest(), every, len(added)))
            columns = list(zip(*out)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], [f.split()[0] for f in RESULT.split(", ")])

    return found.mapInArrow(run, RESULT)


def find(docs: DataFrame, least_digits: int = 5, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of base spans by kind, ``base_sha256`` of
    the base spans, ``spans`` (base and added) as ``kind:start:end`` in code points, ``n_added``.

    A null or empty text has no span; repeated rows give repeated results; other columns are ignored.
    """
    found = durable(extract(docs, least_digits).withColumn("_row", F.monotonically_increasing_id()))
    return render(found, induce(docs, found, **options))
