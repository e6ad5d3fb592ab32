"""Exact top-k inner products by ball trees.

Vectors are dealt to shards, each with a ball tree; queries come in blocks. A block first meets one
home shard; the k-th score it finds there is the bar that all other shards start from. In a shard,
nodes are visited in the order of their upper bound ``q . centre + |q| radius``, and a node whose
bound can't beat the k-th score so far is left out. Components are integers, so scores are exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomesh.session import durable

LIMIT = 1 << 40
EXACT = float(1 << 53)
NONE = np.iinfo(np.int64).min
HITS = "query_id bigint, vec_id bigint, score bigint"


def integer_vector(column: Column) -> Column:
    """floor(256 * x) of every component as long, kept within 2 ** 40; null if a component is null or not finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    value = lambda x: F.least(F.greatest(F.floor(F.lit(256.0) * x.cast("double")).cast("double"), F.lit(-float(LIMIT))), F.lit(float(LIMIT)))
    whole = F.transform(column, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(value(F.when(F.abs(x) > 1e30, F.signum(x) * 1e30).otherwise(x))).cast("long"))
    return F.when(column.isNotNull() & ~bad, whole)


@dataclass
class Node:
    start: int
    end: int
    centre: np.ndarray
    radius: float
    least_id: int
    children: list = field(default_factory=list)


class BallTree:
    """Rows split at the median along the line between two far rows, down to ``leaf`` rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = 128):
        self.order = np.arange(len(ids))
        self.ids, self.rows = ids, rows
        self.leaf = leaf
        self.root = self._build(0, len(ids), rows.astype(float))
        self.ids, self.rows = ids[self.order], rows[self.order]

    def _build(self, start: int, end: int, values: np.ndarray) -> Node:
        own = self.order[start:end]
        points = values[own]
        centre = points.mean(0)
        distance = np.sqrt(((points - centre) ** 2).sum(1))
        node = Node(start, end, centre, float(distance.max()), int(self.ids[own].min()))
        if end - start > self.leaf and node.radius > 0:
            far = points[distance.argmax()]
            other = points[((points - far) ** 2).sum(1).argmax()]
            half = (end - start) // 2
            split = np.argsort(points @ (other - far), kind="stable")
            self.order[start:end] = own[split]
            node.children = [self._build(start, start + half, values), self._build(start + half, end, values)]
        return node


class Search:
    """The k best of a tree's rows for each query, given what is already known of the k-th score."""

    def __init__(self, tree: BallTree, ids: np.ndarray, queries: np.ndarray, k: int, bar: np.ndarray, bar_id: np.ndarray):
        self.tree, self.ids, self.k = tree, ids, k
        most = float(np.abs(tree.rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, tree.rows.shape[1])
        kind = np.float64 if most < EXACT else object  # whole numbers beyond 2 ** 53 as Python's
        self.rows, self.queries = tree.rows.astype(kind), queries.astype(kind)
        self.floats = queries.astype(float)
        self.norms = np.sqrt((self.floats**2).sum(1))
        self.slack = 1e-9 * (most + 1) + 1e-6
        self.best = np.full((len(ids), k), NONE, np.int64)
        self.best_id = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        self.bar, self.bar_id = bar.copy(), bar_id.copy()
        self.visited = 0
        if len(ids):
            self._visit(tree.root, np.arange(len(ids)))

    def _alive(self, node: Node, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bound = self.floats[who] @ node.centre + self.norms[who] * node.radius + self.slack
        bar = self.bar[who].astype(float)
        tied = bound < bar + 1  # it can reach the bar but not pass it
        keep = (bound >= bar) & ~(tied & (node.least_id > self.bar_id[who]) & (np.abs(bar) < EXACT))
        return who[keep], bound[keep]

    def _visit(self, node: Node, who: np.ndarray) -> None:
        who, _ = self._alive(node, who)
        if not len(who):
            return
        if not node.children:
            self._scan(node, who)
            return
        left, right = node.children
        first = self.floats[who] @ (left.centre - right.centre) + self.norms[who] * (left.radius - right.radius) >= 0
        for mine, order in ((who[first], (left, right)), (who[~first], (right, left))):
            if len(mine):
                for child in order:
                    self._visit(child, mine)

    def _scan(self, node: Node, who: np.ndarray) -> None:
        self.visited += len(who) * (node.end - node.start)
        ids = self.tree.ids[node.start : node.end]
        scores = self.queries[who] @ self.rows[node.start : node.end].T
        if scores.dtype == object:
            scores = np.clip(scores, NONE + 1, np.iinfo(np.int64).max)
        scores = scores.astype(np.int64)
        scores[ids[None, :] == self.ids[who][:, None]] = NONE
        some = (scores >= self.bar[who][:, None]).any(1)
        who, scores = who[some], scores[some]
        if not len(who):
            return
        every = np.concatenate([self.best[who], scores], 1)
        every_id = np.concatenate([self.best_id[who], np.broadcast_to(ids, scores.shape)], 1)
        every_id = np.where(every == NONE, np.iinfo(np.int64).max, every_id)
        top = np.lexsort((every_id, np.where(every == NONE, np.iinfo(np.int64).max, -every)), axis=1)[:, : self.k]
        self.best[who] = np.take_along_axis(every, top, 1)
        self.best_id[who] = np.take_along_axis(every_id, top, 1)
        kth, kth_id = self.best[who, -1], self.best_id[who, -1]
        better = (kth > self.bar[who]) | ((kth == self.bar[who]) & (kth_id < self.bar_id[who]))
        self.bar[who[better]], self.bar_id[who[better]] = kth[better], kth_id[better]


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _pairs(vectors: DataFrame, queries: DataFrame, shards: list[int] | None, n_shards: int, n_blocks: int, k: int, dims: int) -> DataFrame:
    """Hits of blocks with shards: with each block's home shard only, or with all others."""
    home = F.pmod(F.col("block"), F.lit(n_shards)).cast("int")
    if shards is None:
        left = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).filter(home == F.col("shard"))
        right = queries.withColumn("shard", home)
    else:
        left = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).filter(home != F.col("shard"))
        right = queries.withColumn("shard", F.explode(F.array(*[F.lit(s) for s in shards]))).filter(home != F.col("shard"))

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if not len(rows) or not len(asked):
            return empty
        tree = BallTree(rows["vec_id"].to_numpy(np.int64), _matrix(rows["vec"], dims))
        ids = asked["query_id"].to_numpy(np.int64)
        found = Search(tree, ids, _matrix(asked["asked"], dims), k, asked["bar"].to_numpy(np.int64), asked["bar_id"].to_numpy(np.int64))
        hit = found.best != NONE
        return pd.DataFrame({"query_id": np.repeat(ids, hit.sum(1)), "vec_id": found.best_id[hit], "score": found.best[hit]})

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(run, HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    # at most k rows per query and shard
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, k: int = 5, shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of every query with all
    other rows of ``rows`` (vec_id, embedding), ties to the smaller vec_id; fewer if there are fewer.

    Queries are the rows whose vec_id satisfies ``is_query``. Rows with a null vec_id, a null vector
    or one with a null or non-finite component take no part. Rows that share a vec_id count as one,
    with the smallest vector. Missing components of shorter vectors count as 0. Other columns are
    ignored.
    """
    spark = rows.sparkSession
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), integer_vector(F.col("embedding")).alias("vec"))
    whole = whole.filter("vec_id is not null and vec is not null").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    stored = durable(whole.withColumn("is_query", F.coalesce(is_query, F.lit(False))))
    n, asked, dims = stored.agg(F.count(F.lit(1)), F.sum(F.col("is_query").cast("long")), F.max(F.size("vec"))).first()
    n_shards, n_blocks = max(1, -(-n // shard_rows)), max(1, -(-(asked or 0) // block_rows))
    deal = lambda seed, parts: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts)).cast("int")
    vectors = stored.select("vec_id", "vec", deal(1, n_shards).alias("shard"))
    queries = stored.filter("is_query").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("asked"), deal(2, n_blocks).alias("block"))
    open_bar = queries.withColumns({"bar": F.lit(int(NONE)), "bar_id": F.lit(int(np.iinfo(np.int64).max))})
    first = durable(_pairs(vectors, open_bar, None, n_shards, n_blocks, k, dims or 0))
    if n_shards == 1:
        return _ranked(first, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    bars = _ranked(first, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bar"), F.col("vec_id").alias("bar_id"))
    barred = queries.join(bars, "query_id", "left").withColumns({"bar": F.coalesce("bar", F.lit(int(NONE))), "bar_id": F.coalesce("bar_id", F.lit(int(np.iinfo(np.int64).max)))})
    rest = _pairs(vectors, barred, list(range(n_shards)), n_shards, n_blocks, k, dims or 0)
    return _ranked(first.unionByName(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
