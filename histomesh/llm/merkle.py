"""Merkle manifest of a dataset, with proofs by checkpoint and recompute.

Rows are leaves of one tree per key, in the order of an id; the trees' roots, in the order of the keys,
are the leaves of one more tree, whose root stands for the whole dataset. Up to ``FAN`` neighbouring
nodes make one node of the level above.

Only every ``EVERY``-th level is stored, as blocks of the ``FAN ** EVERY`` nodes below one node of the
next stored level: an aligned subtree, in one row. Building reads a block and writes its top node.
Proofs go down from the root: a block and the proof of its top node meet in a join, the levels
between are made again from the stored nodes, every node gets its siblings and the top's proof behind
them, and the levels are dropped. A block has a fixed size, so no key, however frequent, is one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.operators.order import row_positions
from histomesh.session import durable, release

FAN, EVERY = 8, 3
BLOCK = FAN**EVERY
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FEW_TREES, FEW_BYTES = 10_000, 1 << 20  # what may be broadcast: trees, bytes of their keys
STEP = "struct<before:string,after:string>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the encoded values, one behind the other."""
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """A-Z as a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tree_key(key: Column) -> Column:
    """The key as a string that is never null; null sorts first, the others bytewise."""
    return F.coalesce(F.concat(F.lit("1"), key.cast("string")), F.lit("0"))


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves until one node is left."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(21)), F.lit(0), lambda h, i: F.when(F.pow(F.lit(float(FAN)), i - 1) < n, i).otherwise(h))


def levels(nodes: list[str], steps: int) -> list[list[str]]:
    """``nodes`` and the ``steps`` levels above them."""
    out = [nodes]
    for _ in range(steps):
        below = out[-1]
        out.append([sha256("".join(below[i : i + FAN]).encode()).hexdigest() for i in range(0, len(below), FAN)])
    return out


def _beside(level: list[str]) -> list[tuple[str, str]]:
    """The siblings before and after every node of a level."""
    out = []
    for start in range(0, len(level), FAN):
        run = level[start : start + FAN]
        out += [("".join(run[:k]), "".join(run[k + 1 :])) for k in range(len(run))]
    return out


@dataclass
class Forest:
    """Stored levels of all trees. ``stored[c]``: (tree, block, height, members) at level ``EVERY * c``, members
    sorted (place, node, row); ``roots``: (tree, root)."""

    stored: list[DataFrame] = field(default_factory=list)
    roots: DataFrame | None = None


def _blocks(nodes: DataFrame, row: Column) -> DataFrame:
    members = F.array_sort(F.collect_list(F.struct("place", "node", row.alias("row"))))  # BLOCK entries at most
    return nodes.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.first("height").alias("height"), members.alias("members"))


def _tops(blocks: DataFrame, level: int) -> DataFrame:
    """(tree, height, place, node): the node above every block, EVERY levels up or at the tree's top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(3)
            nodes, at = held.flatten().field("node").to_pylist(), [0, *_cumulated(held.value_lengths().to_pylist())]
            heights = batch.column(2).to_pylist()
            tops = [levels(nodes[a:b], min(EVERY, h - level))[-1][0] for a, b, h in zip(at, at[1:], heights)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(tops, pa.string())], ["tree", "height", "place", "node"])

    return blocks.select("tree", "block", "height", "members").mapInArrow(run, "tree string, height int, place bigint, node string")


def _cumulated(sizes: list[int]) -> list[int]:
    out, total = [], 0
    for n in sizes:
        total += n
        out.append(total)
    return out


def build(leaves: DataFrame, order: list[str], carry: list[str]) -> Forest:
    """Trees over ``leaves`` (tree, node, ``order`` and ``carry`` columns); equal places are told apart by the node."""
    rows = leaves.select("tree", "node", *[c for c in dict.fromkeys([*order, *carry])])
    placed = row_positions(rows, ["tree"], [*order, "node"], "place")
    sizes = durable(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).withColumn("height", _height(F.col("n"))).drop("n"))
    spread = sizes.agg(F.count(F.lit(1)), F.sum(F.octet_length("tree")), F.max("height")).first()
    small = F.broadcast(sizes) if spread[0] <= FEW_TREES and (spread[1] or 0) <= FEW_BYTES else sizes
    forest, top = Forest(), spread[2] or 0
    nodes = placed.join(small, "tree")
    blocks = durable(_blocks(nodes, F.struct(*carry)))
    level, roots = 0, None
    while True:
        forest.stored.append(blocks)
        above = durable(_tops(blocks, level))
        ends = above.filter(F.col("height") <= level + EVERY).select("tree", F.col("node").alias("root"))
        roots = ends if roots is None else roots.unionAll(ends)
        level += EVERY
        if top <= level:
            break
        blocks = durable(_blocks(above.filter(F.col("height") > level), F.lit(None).cast("int")))
    forest.roots = durable(roots)
    release(sizes)
    return forest


def _extract(blocks: DataFrame, level: int) -> DataFrame:
    """(tree, place, node, row, proof, extra) of every node of ``blocks`` (tree, block, height, members, above, extra).

    ``above`` is the proof of the block's top node. The levels in between exist only here.
    """
    row, extra = blocks.schema["members"].dataType.elementType["row"].dataType, blocks.schema["extra"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members = batch.column("members").slice(i, 1).flatten()
                n = len(members)
                own = levels(members.field("node").to_pylist(), min(EVERY, batch.column("height")[i].as_py() - level))
                beside = [_beside(x) for x in own[:-1]]
                above = [(s["before"], s["after"]) for s in batch.column("above")[i].as_py()]
                before, after = [], []
                for k in range(n):
                    for up, pairs in enumerate(beside):
                        b, a = pairs[k // FAN**up]
                        before.append(b)
                        after.append(a)
                    for b, a in above:
                        before.append(b)
                        after.append(a)
                size = len(beside) + len(above)
                offsets = pa.array(range(0, n * size + 1, size) if size else [0] * (n + 1), pa.int32())
                steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("tree").take([i] * n), members.field("place"), members.field("node"), members.field("row"),
                     pa.ListArray.from_arrays(offsets, steps), batch.column("extra").take([i] * n)],
                    ["tree", "place", "node", "row", "proof", "extra"],
                )

    schema = f"tree string, place bigint, node string, row {row.simpleString()}, proof array<{STEP}>, extra {extra.simpleString()}"
    return blocks.select("tree", "block", "height", "members", "above", "extra").mapInArrow(run, schema)


def prove(forest: Forest, ends: DataFrame) -> DataFrame:
    """(tree, place, node, row, proof, extra) of every leaf. ``ends``: (tree, above, extra), the proof that
    goes on behind each tree's root and columns to hand down."""
    above = None
    for c in reversed(range(len(forest.stored))):
        blocks, level = forest.stored[c], EVERY * c
        tops = blocks.filter(F.col("height") <= level + EVERY).select("tree", F.lit(0).cast("long").alias("block")).join(ends, "tree")
        if above is not None:
            tops = tops.unionByName(above.select("tree", F.col("place").alias("block"), F.col("proof").alias("above"), "extra"))
        above = _extract(blocks.join(tops, ["tree", "block"]), level)
        if c:
            above = durable(above.drop("row"))
    return above


def manifest(docs: DataFrame, key: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: the ``order`` column, ``carry`` columns, leaf, subroot, root and proof.

    A leaf is the digest of the row's ``fields``. Within a key, leaves ascend by ``order`` (null first), rows
    that share it by their digest; the keys' roots ascend by key (null first, then bytewise). ``proof`` lists,
    from the leaf up to the dataset's root, the siblings that stand before and after the path's node,
    joined. Repeated rows have the same leaf, each at its own place; null and empty fields give
    different leaves. Columns that aren't in ``fields`` change nothing. No rows give no rows.
    """
    extra = {"_order": F.col(order), **{f"_c_{k}": c for k, c in (carry or {}).items()}}
    leaves = docs.select(_tree_key(F.col(key)).alias("tree"), leaf_digest(*[F.col(f) for f in fields]).alias("node"), *[c.alias(k) for k, c in extra.items()])
    inner = build(leaves, ["_order"], list(extra))
    outer = build(inner.roots.select(F.lit("").alias("tree"), F.col("root").alias("node"), F.col("tree").alias("key")), ["key"], ["key"])
    start = outer.roots.select("tree", F.array().cast(f"array<{STEP}>").alias("above"), F.struct("root").alias("extra"))
    tops = durable(prove(outer, start))
    ends = tops.select(F.col("row.key").alias("tree"), F.col("proof").alias("above"), F.struct(F.col("node").alias("subroot"), "extra.root").alias("extra"))
    out = prove(inner, ends)
    return out.select(
        F.col("row._order").alias(order), *[F.col(f"row._c_{k}").alias(k) for k in carry or {}],
        F.col("node").alias("leaf"), F.col("extra.subroot").alias("subroot"), F.col("extra.root").alias("root"), "proof",
    )


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``proof`` give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)
