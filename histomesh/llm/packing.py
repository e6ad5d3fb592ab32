"""Packing into optimal length buckets.

The histogram of all aligned lengths is built in Spark; dynamic programming on it picks the bucket
lengths for which all documents, padded to their bucket's length, take the fewest tokens. Inside a
bucket, documents fill batches of a token budget in the order of their ids. Places in a bucket are
counted by ranges, so a bucket that holds most documents is not one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.operators.order import row_positions
from histomesh.session import durable


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a null or blank text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` of the sorted ``lengths`` as bucket lengths, the largest among them, so
    that padding every document to the next of them costs least.

    Exact: cost[j] of the first j lengths in k buckets is the least, over the last bucket's first
    length i, of cost[i] in k - 1 plus lengths[j] for each document in between. Of equal costs the
    smallest i is taken. That i never falls as j grows, so that the middle j's i bounds those of both
    halves: n log n steps a bucket.
    """
    lengths, n = np.asarray(lengths, np.int64), len(lengths)
    if n == 0:
        return []
    total = np.r_[0, np.cumsum(counts)].astype(np.int64)
    far = np.iinfo(np.int64).max // 4
    cost = np.full(n + 1, far, np.int64)
    cost[0] = 0
    choice = []
    for k in range(1, min(buckets, n) + 1):
        best, where = np.full(n + 1, far, np.int64), np.zeros(n + 1, np.int64)
        open_ = [(k, n, k - 1, n - 1)]  # k buckets hold k lengths or more
        while open_:
            first, last, low, high = open_.pop()
            j = (first + last) // 2
            some = slice(low, min(high, j - 1) + 1)
            whole = cost[some] + (total[j] - total[some]) * lengths[j - 1]
            i = low + int(whole.argmin())
            best[j], where[j] = whole[i - low], i
            if first < j:
                open_.append((first, j - 1, low, i))
            if j < last:
                open_.append((j + 1, last, i, high))
        cost = best
        choice.append(where)
    out, j = [], n
    for where in reversed(choice):
        out.append(int(lengths[j - 1]))
        j = int(where[j])
    return out[::-1]


def pack(docs: DataFrame, length: Column, buckets: int = 8, align: int = 64, budget: int = 16384) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, bucket, bucket_length, batch, slot.

    ``length`` is a document's number of tokens (null: 0). Lengths are padded to multiples of
    ``align``; every aligned length that occurs is a choice, however long the longest. A bucket's batches hold
    ``budget // bucket_length`` documents, one at least. Repeated rows take a slot each; null ids
    come first. An empty table gives no row.
    """
    spark = docs.sparkSession
    rows = durable(docs.select("doc_id", F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens")))
    padded = F.greatest(F.ceil(F.col("n_tokens") / align), F.lit(1)).cast("long") * align
    histogram = rows.groupBy(padded.alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()  # as many rows as aligned lengths occur: m of them take align * m ** 2 / 2 tokens
    chosen = optimal_buckets(np.array([r.length for r in histogram], np.int64), np.array([r.n for r in histogram], np.int64), buckets)
    bounds = spark.createDataFrame(list(enumerate(chosen)), "bucket int, bucket_length bigint")
    first = F.expr(f"array_position(transform(array({','.join(map(str, chosen)) or 0}), b -> b >= n_padded), true) - 1")
    placed = rows.withColumn("n_padded", padded).withColumn("bucket", first.cast("int")).drop("n_padded")
    placed = row_positions(placed, ["bucket"], ["doc_id", "n_tokens"], "place").join(F.broadcast(bounds), "bucket")
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length"))).cast("long")
    return placed.select(
        "doc_id", "n_tokens", "bucket", "bucket_length",
        F.floor(F.col("place") / per_batch).cast("long").alias("batch"), (F.col("place") % per_batch).cast("long").alias("slot"),
    )
