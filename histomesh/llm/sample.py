"""Bounded labelled samples that classifiers are trained on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.session import durable


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, max_bytes: int) -> tuple[list[tuple[str, int]], float]:
    """(text, 0/1) pairs for training on the driver, and the share of label 1 among all labelled rows.

    Of the labelled documents that satisfy ``train`` (a condition on doc_id), the first
    ``per_class`` of either class in the order of a hash of doc_id are taken, until their texts
    reach ``max_bytes`` per class; both bounds hold at every table size. Texts are whole: one that
    would pass the bound is left out. Null labels and labels without a document don't count; of
    several labels of one document the largest holds.
    """
    known = durable(
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .filter(train)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("_label"))
    )
    share = known.agg(F.avg(F.col("_label").cast("double"))).first()[0]
    if share is None:
        return [], 0.5
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.filter(F.col("_label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    return whole_texts(docs, picked[0].unionAll(picked[1]), max_bytes), share


def whole_texts(docs: DataFrame, ids: DataFrame, max_bytes: int) -> list[tuple[str, int]]:
    """(text, label) of the documents in ``ids`` (doc_id, _label), a number of rows bounded by the
    caller; of each label as many whole texts, in hash order, as fit into ``max_bytes``."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).join(F.broadcast(ids), "doc_id")
    stored = durable(texts.withColumn("_bytes", F.octet_length("_text")))
    sizes = stored.groupBy("doc_id").agg(F.max("_label").alias("_label"), F.max("_bytes").alias("_bytes")).orderBy(*order).collect()
    used: dict = {}
    chosen = []
    for row in sizes:
        if used.get(row._label, 0) + row._bytes <= max_bytes:
            used[row._label] = used.get(row._label, 0) + row._bytes
            chosen.append(row.doc_id)
    kept = stored.filter(F.col("doc_id").isin(chosen)).groupBy("doc_id").agg(F.max("_label").alias("_label"), F.max("_text").alias("_text"))
    return [(r._text, r._label) for r in kept.orderBy(*order).collect()]
