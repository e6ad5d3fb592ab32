"""Near-duplicate documents by a MinHash LSH forest.

Each tree orders the documents by its own sequence of MinHash values. Documents whose sequences
share a prefix lie next to each other; a region with one common prefix is compared as a whole if it
is small, and otherwise split by a longer prefix, so that the depth follows the density. Candidate
pairs pass three tests: sizes within the similarity (exact); parity maps, whose difference is a lower
bound of the sets' difference (exact); and a wide test on one-bit MinHash sketches. Links are
confirmed on the full shingle sets.

Equal sets are merged before, so copies cost one row. Links are found in two steps: first every
document with its most similar candidate; then, in regions that still hold several components, all
candidates between different ones. Candidates inside one component can't change the result.

Splitting a crowded region loses pairs. The sets of every region that was split, or that the border of
a range may have cut, therefore meet once more after the first step, on the rare shingles of a prefix
filter. In rounds, each set meets the first and the last component of every shingle's sets, two pairs a
set and round, and confirmed links merge components, until a round brings nothing new; what is
still apart then meets in an exact join (see ``crowd_pairs``). So a link is missed only if its sets share
no SHALLOWEST values in any tree, or if their sketches differ by five deviations more than the
threshold lets expect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.llm.graph import components
from histomesh.llm.text import blocks, buffer_of, mix, shingles, words
from histomesh.session import durable, release

TREES, DEPTH, SHALLOWEST, CROWD, NEIGHBOURS = 16, 8, 4, 48, 2
BITS = TREES * DEPTH
PARITY = 4  # words of 64 bits
RARITY = 1 << 16
HUB_ROUNDS = 8
_rng = np.random.default_rng(20_240_615)
_A = _rng.integers(0, 1 << 32, BITS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BITS, dtype=np.uint64).astype(np.uint32)


def distinct_sets(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, hash) pairs, rows in their order."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.r_[True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])] if len(rows) else np.zeros(0, bool)
    return rows[first], hashes[first]


def signatures(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """MinHash values (rows that have a shingle x BITS) of distinct, row-sorted shingles."""
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), BITS), np.uint32)
    for i in range(BITS):
        out[:, i] = np.minimum.reduceat(x * _A[i] + _B[i], first)
    return out


def parity_maps(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each row that has a shingle, the parity of the shingles that fall on each of 64 * PARITY bits.

    Two maps differ in as many bits as the sets differ in elements, or fewer.
    """
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    bit = np.uint64(1) << (hashes & np.uint64(63))
    word = (hashes >> np.uint64(6)) % np.uint64(PARITY)
    return np.stack([np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), first) for k in range(PARITY)], 1)


def sign(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, signature) of every row; the signature is the MinHash
    values and the parity map. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffer, offsets = buffer_of(batch.column(1))
            for a, b in blocks(offsets, 1 << 19):
                rows, _, _, hashes = words(buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows, _, hashes = shingles(rows, hashes, size)
                rows, hashes = distinct_sets(rows, hashes)
                count = np.bincount(rows, minlength=b - a)
                some = np.flatnonzero(count)
                digests = [np.zeros(b - a, np.uint64) for _ in range(2)]
                packed: list = [None] * (b - a)
                if len(some):
                    first = np.cumsum(count[some]) - count[some]
                    for d, seed in zip(digests, (1, 2)):
                        d[some] = np.add.reduceat(mix(hashes ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))), first)
                    for i, s, p in zip(some, signatures(rows, hashes), parity_maps(rows, hashes)):
                        packed[i] = s.tobytes() + p.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(count, pa.int64()), *(pa.array(d.view(np.int64)) for d in digests), pa.array(packed, pa.binary())],
                    ["doc_id", "n_shingles", "digest", "digest2", "signature"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest bigint, digest2 bigint, signature binary")


def forest(sets: DataFrame) -> DataFrame:
    """One row per tree and set: (tree, prefix, node, n, sketch), in the tree's order.

    The prefix is the DEPTH values as big-endian bytes, so that its order is that of the values. Rows
    are dealt out by ranges of the order, which splits regions of any size; a pair that a range
    boundary cuts in one tree is met in the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            signed = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, 4 * BITS + 8 * PARITY)
            values = np.ascontiguousarray(signed[:, : 4 * BITS]).view(np.uint32)
            sketch = np.concatenate([np.packbits(values & 1, axis=1), signed[:, 4 * BITS :]], 1)
            sketches = [s.tobytes() for s in sketch]
            big = np.ascontiguousarray(values.astype(">u4"))
            for t in range(TREES):
                own = np.ascontiguousarray(big[:, t * DEPTH : (t + 1) * DEPTH])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, t), pa.int32()), pa.array([p.tobytes() for p in own], pa.binary()), batch.column(0), batch.column(1), pa.array(sketches, pa.binary())],
                    ["tree", "prefix", "node", "n", "sketch"],
                )

    spark = sets.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    laid = sets.select("node", "n", "signature").mapInArrow(run, "tree int, prefix binary, node bigint, n bigint, sketch binary")
    return laid.repartitionByRange(width, "tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")


def regions(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) rows of the regions of a sorted run; lcp[i] is the common depth of rows i and i + 1.

    Regions of SHALLOWEST common values; crowded ones are split by one more value until they hold
    CROWD rows at most. Crowds that share all DEPTH values become blocks that overlap by one row.
    """
    out_first, out_last = [], []
    first = np.flatnonzero(np.r_[True, lcp < SHALLOWEST])
    last = np.r_[first[1:], len(lcp) + 1] - 1
    depth = SHALLOWEST
    while len(first):
        crowded = last - first + 1 > CROWD
        done = ~crowded & (last > first)
        out_first.append(first[done])
        out_last.append(last[done])
        first, last = first[crowded], last[crowded]
        depth += 1
        if depth > DEPTH:
            for a, b in zip(first, last):
                starts = np.arange(a, b, CROWD - 1)
                out_first.append(starts)
                out_last.append(np.minimum(starts + CROWD - 1, b))
            break
        pieces = [np.r_[a, a + 1 + np.flatnonzero(lcp[a:b] < depth), b + 1] for a, b in zip(first, last)]
        first = np.concatenate([p[:-1] for p in pieces]) if pieces else first
        last = np.concatenate([p[1:] - 1 for p in pieces]) if pieces else last
    return np.concatenate(out_first).astype(np.int64), np.concatenate(out_last).astype(np.int64)


def uncertain(lcp: np.ndarray) -> np.ndarray:
    """Rows of a sorted run whose region of SHALLOWEST common values was split or may go on in another run."""
    first = np.flatnonzero(np.r_[True, lcp < SHALLOWEST])
    size = np.diff(np.r_[first, len(lcp) + 1])
    chosen = size > CROWD
    chosen[[0, -1]] = True
    return np.flatnonzero(np.repeat(chosen, size))


def _similar(n: np.ndarray, sketch: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: int, slack: float) -> np.ndarray:
    """Estimated similarity of the pairs, -1 for those that fail the size, parity or sketch test."""
    differ = np.bitwise_count(sketch[i] ^ sketch[j]).astype(np.int64)
    equal, apart = BITS - differ[:, : BITS // 64].sum(1), differ[:, BITS // 64 :].sum(1)
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    share = (1 + threshold / 100) / 2
    least = BITS * share - slack * np.sqrt(BITS * share * (1 - share))
    near = (100 * small >= threshold * large) & ((100 + threshold) * apart <= (100 - threshold) * (small + large))
    return np.where(near & (equal >= least), equal, -1)


def candidates(ordered: DataFrame, threshold: int, slack: float = 5.0) -> DataFrame:
    """Rows of three kinds: (node, other, similarity), each node's most similar earlier one in a region;
    (members, sizes, sketches), a region that holds more candidates than those; and (crowd), nodes
    of which a region's other members were not all compared with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # one range of one sorted order
        if not table.num_rows:
            return
        m = table.num_rows
        tree, node, n = (table.column(c).to_numpy() for c in ("tree", "node", "n"))
        prefix = np.frombuffer(b"".join(table.column("prefix").to_pylist()), ">u4").reshape(m, DEPTH)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(m, BITS // 64 + PARITY)
        same = (prefix[1:] == prefix[:-1]) & (tree[1:] == tree[:-1])[:, None]
        lcp = np.logical_and.accumulate(same, axis=1).sum(1)
        crowd = np.unique(node[uncertain(lcp)])
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(crowd), t) for t in _PAIR), *(pa.nulls(len(crowd), t) for t in _REGION), pa.array(crowd)], _CANDIDATE_NAMES)
        first, last = regions(lcp)
        pair_i, pair_j, score, region = [], [], [], []
        length = last - first
        for gap in range(1, int(length.max(initial=0)) + 1):
            wide = np.flatnonzero(length >= gap)
            reach = length[wide] - gap + 1
            i = np.repeat(first[wide], reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
            s = _similar(n, sketch, i, i + gap, threshold, slack)
            ok = s >= 0
            pair_i.append(i[ok])
            pair_j.append(i[ok] + gap)
            score.append(s[ok])
            region.append(np.repeat(wide, reach)[ok])
        near = np.full(m, -1)
        for gap in range(1, NEIGHBOURS + 1):  # longest common prefixes across the borders of regions
            if m <= gap:
                break
            shared = np.min([lcp[k : m - gap + k] for k in range(gap)], axis=0) >= SHALLOWEST
            i = np.flatnonzero(shared)
            s = _similar(n, sketch, i, i + gap, threshold, slack)
            ok = s >= 0
            pair_i.append(i[ok])
            pair_j.append(i[ok] + gap)
            score.append(s[ok])
            region.append(near[i[ok]])
        i, j, s, r = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pair_i, pair_j, score, region))
        if not len(i):
            return
        order = np.lexsort((node[i], -s, j))
        best = order[np.r_[True, j[order][1:] != j[order][:-1]]]
        border = np.setdiff1d(np.flatnonzero(r < 0), best)
        out = np.concatenate([best, border])
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[j[out]]), pa.array(node[i[out]]), pa.array(s[out].astype(np.int32)), *(pa.nulls(len(out), t) for t in _REGION), pa.nulls(len(out), pa.int64())],
            _CANDIDATE_NAMES,
        )
        inside = r[r >= 0]
        more = np.bincount(inside, minlength=len(first)) - np.bincount(r[best][r[best] >= 0], minlength=len(first))
        rich = np.flatnonzero(more > 0)
        for at in range(0, len(rich), 2048):
            chosen = rich[at : at + 2048]
            cut = [slice(first[k], last[k] + 1) for k in chosen]
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(len(cut), t) for t in _PAIR), pa.array([node[c].tolist() for c in cut], _REGION[0]), pa.array([n[c].tolist() for c in cut], _REGION[1]),
                 pa.array([sketch[c].tobytes() for c in cut], _REGION[2]), pa.nulls(len(cut), pa.int64())],
                _CANDIDATE_NAMES,
            )

    return ordered.mapInArrow(run, "node bigint, other bigint, similarity int, members array<bigint>, sizes array<bigint>, sketches binary, crowd bigint")


_PAIR = (pa.int64(), pa.int64(), pa.int32())
_REGION = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
_CANDIDATE_NAMES = ["node", "other", "similarity", "members", "sizes", "sketches", "crowd"]


def confirm(pairs: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full shingle sets have 100 * intersection >= threshold * union."""
    ids = durable(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(ids, "id", "left_semi")
    texts = durable(texts)
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keep = np.zeros(n, bool)
            sides = [buffer_of(batch.column(c)) for c in (2, 3)]
            for a, b in blocks(sides[0][1] + sides[1][1], 1 << 20):
                sets = []
                for buffer, offsets in sides:
                    rows, _, _, hashes = words(buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    rows, _, hashes = shingles(rows, hashes, size)
                    sets.append(distinct_sets(rows, hashes))
                rows, hashes = (np.concatenate(x) for x in zip(*sets))
                order = np.lexsort((hashes, rows))
                rows, hashes = rows[order], hashes[order]
                twice = (rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1])
                both = np.bincount(rows[1:][twice], minlength=b - a)
                either = np.bincount(rows, minlength=b - a) - both
                keep[a:b] = (100 * both >= threshold * either) & (either > 0)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return joined.mapInArrow(run, "a bigint, b bigint").distinct()


def across(found: DataFrame, labels: DataFrame, threshold: int, slack: float = 5.0) -> DataFrame:
    """Candidate pairs (a, b) of stored regions and borders whose ends lie in different components."""
    own = lambda name, to: labels.select(F.col("node").alias(name), F.col("label").alias(to))
    loose = found.filter("node is not null").select(F.col("other").alias("a"), F.col("node").alias("b")).distinct()
    loose = loose.join(own("a", "la"), "a", "left").join(own("b", "lb"), "b", "left")
    loose = loose.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    held = durable(found.filter("members is not null").select(F.monotonically_increasing_id().alias("region"), "members", "sizes", "sketches"))
    each = held.select("region", F.explode("members").alias("node")).join(labels, "node", "left").select("region", "node", F.coalesce("label", "node").alias("label"))
    # a region has CROWD members at most
    mixed = each.groupBy("region").agg(F.map_from_entries(F.collect_set(F.struct("node", "label"))).alias("of"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    mixed = held.join(mixed, "region").select("members", "sizes", "sketches", F.transform("members", lambda x: F.col("of")[x]).alias("labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                node, n, label = np.array(row["members"]), np.array(row["sizes"]), np.array(row["labels"])
                sketch = np.frombuffer(row["sketches"], np.uint64).reshape(len(node), -1)
                i, j = np.triu_indices(len(node), 1)
                i, j = i[label[i] != label[j]], j[label[i] != label[j]]
                ok = _similar(n, sketch, i, j, threshold, slack) >= 0
                yield pa.RecordBatch.from_arrays([pa.array(node[i[ok]]), pa.array(node[j[ok]])], ["a", "b"])

    pairs = loose.unionAll(mixed.mapInArrow(run, "a bigint, b bigint"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def shingle_levels(texts: DataFrame, size: int) -> np.ndarray:
    """How many sets hold a shingle of each of RARITY hash buckets: a constant in size, summed in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY, np.int64)
        for batch in batches:
            buffer, offsets = buffer_of(batch.column(0))
            for a, b in blocks(offsets, 1 << 20):
                rows, _, _, hashes = words(buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows, _, hashes = shingles(rows, hashes, size)
                total += np.bincount((distinct_sets(rows, hashes)[1] % np.uint64(RARITY)).astype(np.int64), minlength=RARITY)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(RARITY, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def crowd_rows(crowd: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """(node, n, at, shingle, p0, ...): the prefix of every set in ``crowd`` (node), with its parity map.

    Shingles are ordered by rarity (counts by hash bucket, then hash). Two sets of the similarity t
    share one of their first ``n - ceil(t n) + 1`` shingles.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = durable(texts.join(crowd.select(F.col("node").alias("id")), "id", "left_semi"))
    shared = docs.sparkSession.sparkContext.broadcast(shingle_levels(texts, size))  # RARITY numbers
    maps = [f"p{k}" for k in range(PARITY)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            buffer, offsets = buffer_of(batch.column(1))
            for a, b in blocks(offsets, 1 << 20):
                rows, _, _, hashes = words(buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows, _, hashes = shingles(rows, hashes, size)
                rows, hashes = distinct_sets(rows, hashes)
                order = np.lexsort((hashes, levels[(hashes % np.uint64(RARITY)).astype(np.int64)], rows))
                hashes = hashes[order]
                count = np.bincount(rows, minlength=b - a)
                parity = np.zeros((b - a, PARITY), np.uint64)
                if len(rows):
                    parity[count > 0] = parity_maps(rows, hashes)
                at = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
                keep = at < (count - (threshold * count + 99) // 100 + 1)[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b][rows[keep]]), pa.array(count[rows[keep]]), pa.array(at[keep]), pa.array(hashes[keep].view(np.int64)), *(pa.array(parity[rows[keep], k].view(np.int64)) for k in range(PARITY))],
                    ["node", "n", "at", "shingle", *maps],
                )

    rows = durable(texts.mapInArrow(run, "node bigint, n bigint, at bigint, shingle bigint, " + ", ".join(f"{p} bigint" for p in maps)))
    release(texts)
    return rows


def _may_link(x: str, y: str, threshold: int) -> Column:
    """Whether two prefix rows that share a shingle can be a link: sizes, the overlap still possible from there on,
    and parity maps within the sets' difference. Exact: no link fails at the first shingle it shares."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    rest = F.least(n - F.col(f"{x}.at"), m - F.col(f"{y}.at"))  # at the first shingle they share, nothing stands before
    may = (100 * n >= threshold * m) & (100 * m >= threshold * n) & (rest * (100 + threshold) >= (n + m) * threshold)
    return may & (_parity_apart(x, y) * (100 + threshold) <= (n + m) * (100 - threshold))


def _parity_apart(x: str, y: str) -> Column:
    return sum((F.bit_count(F.col(f"{x}.p{k}").bitwiseXOR(F.col(f"{y}.p{k}"))) for k in range(1, PARITY)), F.bit_count(F.col(f"{x}.p0").bitwiseXOR(F.col(f"{y}.p0"))))


def _open_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with their labels, of the shingles that more than one component holds."""
    known = durable(rows.join(labels, "node"))
    mixed = known.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("shingle")
    out = durable(known.join(mixed, "shingle", "left_semi"))
    release(known)
    return out


def hub_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b): of every set, its closest candidate among the first sets of the smallest label at its shingles, and
    among those of the largest: two pairs a set at most."""
    whole = F.struct("label", "node", "n", "at", *[f"p{k}" for k in range(PARITY)])
    hubs = rows.groupBy("shingle").agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"))
    sides = F.posexplode(F.array("lo", "hi")).alias("side", "y")
    met = rows.join(hubs, "shingle").select(whole.alias("x"), sides).filter("x.label <> y.label")
    met = met.filter(_may_link("x", "y", threshold))
    best = met.groupBy("x.node", "side").agg(F.min(F.struct(_parity_apart("x", "y").alias("apart"), F.col("y.node").alias("other"))).alias("b"))
    return best.select(F.least("node", "b.other").alias("a"), F.greatest("node", "b.other").alias("b")).filter("a <> b").distinct()


def crowd_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b): all pairs of prefix ``rows`` that may link and lie in different components. Exact: none is left out."""
    x, y = rows.alias("x"), rows.alias("y")
    # rows of one node that stand for different sets of a shared doc_id have one label
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") < F.col("y.label")) & _may_link("x", "y", threshold))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the components that ``links`` (a, b) join have become one."""
    lifted = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
    lifted = lifted.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    outer = components(lifted.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    moved = labels.join(outer.select(F.col("node").alias("label"), F.col("label").alias("outer")), "label", "left")
    return durable(moved.select("node", F.coalesce("outer", "label").alias("label")))


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents with a Jaccard similarity of ``threshold`` per cent of their sets of ``size``-word
    shingles are linked; component_id is the smallest doc_id reachable, kept whether it is the own
    one. Null, empty and blank texts have no shingle and are linked with nothing. Rows that share a
    doc_id are one document. A null doc_id takes no part: no component, kept. Other columns are
    ignored.
    """
    signed = durable(sign(docs, size))
    named = signed.filter("doc_id is not null")
    heads = durable(named.filter("n_shingles > 0").groupBy("digest", "digest2").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n")))
    firsts = named.filter("n_shingles > 0").select(F.col("doc_id").alias("node"), "digest", "digest2", "signature")
    sets = durable(firsts.join(heads, ["node", "digest", "digest2"]).dropDuplicates(["node", "digest", "digest2"]))
    found = durable(candidates(forest(sets), threshold))
    best = found.filter("node is not null").groupBy("node").agg(F.max_by("other", F.struct("similarity", -F.col("other"))).alias("other"))
    first = durable(confirm(best.select(F.col("other").alias("a"), F.col("node").alias("b")).filter("a <> b"), docs, size, threshold))
    # rows of one doc_id with different sets
    split = durable(named.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo < hi").select("doc_id"))
    sames = named.join(split, "doc_id", "left_semi").filter("n_shingles > 0").join(heads, ["digest", "digest2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    first = durable(first.unionAll(sames))
    own = components(first)
    labels = durable(heads.select("node").distinct().join(own, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    crowd = durable(sets.join(found.filter("crowd is not null").select(F.col("crowd").alias("node")).distinct(), "node", "left_semi").select("node").distinct())
    prefixes, tried = crowd_rows(crowd, docs, size, threshold), None
    release(own, crowd)
    for _ in range(HUB_ROUNDS):
        rows = _open_rows(prefixes, labels)
        pairs = hub_pairs(rows, threshold)
        pairs = durable(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs)
        links = durable(confirm(pairs, docs, size, threshold))
        tried = durable(pairs if tried is None else tried.unionAll(pairs))
        release(rows, pairs)
        if links.isEmpty():
            break
        labels = merged(labels, links)
        release(links)
    rows = _open_rows(prefixes, labels)
    beyond = across(found, labels, threshold).unionAll(crowd_pairs(rows, threshold)).distinct().join(tried, ["a", "b"], "left_anti")
    beyond = durable(beyond)
    labels = merged(labels, durable(confirm(beyond, docs, size, threshold)))
    release(prefixes, rows, found, beyond, tried)
    reached = durable(heads.join(labels, "node").select("digest", "digest2", F.col("label").alias("_component")))
    rows = signed.select("doc_id", "n_shingles", "digest", "digest2").join(reached, ["digest", "digest2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id")))
    rows = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id, with all columns.

    Of rows that share a doc_id the smallest row stays. Rows with a null id stay.
    """
    kept = near_duplicates(docs, size, threshold).filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    kept = durable(kept.select(F.col("doc_id").alias("_id"), "rows"))
    match = docs["doc_id"].cast("long") == F.col("_id")
    parts = docs.filter(F.col("doc_id").isNull()).unionAll(docs.join(kept.filter("rows = 1"), match, "left_semi"))
    repeated = kept.filter("rows > 1")
    if repeated.isEmpty():
        return parts
    smallest = docs.join(repeated, match, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return parts.unionAll(smallest.select(*[F.col(f"_row.{c}").alias(c) for c in docs.columns]))
