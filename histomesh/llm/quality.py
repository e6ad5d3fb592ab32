"""Byte-level convolutional quality classifier.

A document's UTF-8 bytes are cut into overlapping chunks that cover the whole text. Each byte
carries a second bit: whether the four bytes from here on occurred a few bytes earlier, so that
filters can learn stutter. Learned filters run over every chunk; each filter's maximum in a chunk
is pooled over chunks by maximum and mean, and one logistic unit makes the probability. Training
is Adam with hand-written gradients in numpy over a bounded sample of labelled rows; scoring is
one pass over all documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from histomesh.llm.sample import labelled_sample
from histomesh.llm.text import blocks, buffer_of

CHUNK, STEP, WIDTH, STRIDE = 512, 448, 8, 2
POSITIONS = CHUNK // STRIDE
LAGS = range(2, 21)
PAD = 24
LEAST_STEPS = 300


@dataclass
class Network:
    embed: np.ndarray  # 512 symbols x dims
    filters: np.ndarray  # width x dims x filters
    bias: np.ndarray
    out: np.ndarray  # weights of [max over chunks, mean over chunks]
    shift: float

    def tables(self) -> np.ndarray:
        """width x 512 x filters: what a symbol at an offset adds to each filter."""
        return np.einsum("sd,wdf->wsf", self.embed, self.filters).astype(np.float32)


def chunk_symbols(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all chunks (chunks x (CHUNK + WIDTH)) and the row of each chunk.

    Every row has a chunk at least. Rows are set apart by zero bytes, so a row's symbols don't
    depend on its neighbours in the batch.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    begin = offsets[:-1] + PAD * np.arange(1, n + 1)
    padded = np.zeros(int(offsets[-1]) + PAD * (n + 1) + CHUNK + WIDTH, np.uint8)
    rows_of_bytes = np.repeat(np.arange(n), sizes)
    padded[np.arange(len(buffer)) + PAD * (rows_of_bytes + 1)] = buffer
    quad = padded[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        quad |= padded[k : len(padded) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    again = np.zeros(len(padded), bool)
    for lag in LAGS:
        again[lag : len(quad)] |= quad[lag:] == quad[:-lag]
    symbols = padded.astype(np.uint16)
    symbols[again] += np.uint16(256)
    symbols[padded == 0] = 0
    count = np.maximum(1, -(-(sizes - (CHUNK - STEP)) // STEP))
    row = np.repeat(np.arange(n), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = begin[row] + within * STEP
    at = start[:, None] + np.arange(CHUNK + WIDTH)[None, :]
    out = symbols[np.minimum(at, len(symbols) - 1)]
    out[at >= (begin + sizes)[row][:, None]] = 0
    return out, row


def convolve(tables: np.ndarray, bias: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """chunks x positions x filters."""
    total = np.take(tables[0], symbols[:, 0 : STRIDE * POSITIONS : STRIDE], axis=0)
    for k in range(1, WIDTH):
        total += np.take(tables[k], symbols[:, k : k + STRIDE * POSITIONS : STRIDE], axis=0)
    return total + bias


def _pool(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.searchsorted(row, np.arange(n))
    count = np.diff(np.r_[first, len(row)])
    return np.maximum.reduceat(values, first, axis=0), np.add.reduceat(values, first, axis=0) / count[:, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(sample: list[tuple[str, int]], share: float, filters: int = 16, dims: int = 8, epochs: int = 14, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Network | None:
    """Fits the network; None if the sample lacks one of the classes."""
    labels = np.array([y for _, y in sample], np.float32)
    if len(sample) == 0 or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    per_doc = []
    for text, _ in sample:
        data = np.frombuffer(text.encode(), np.uint8)
        per_doc.append(chunk_symbols(data, np.array([0, len(data)]))[0])
    p = {
        "embed": rng.normal(0, 0.3, (512, dims)),
        "filters": rng.normal(0, 0.3, (WIDTH, dims, filters)),
        "bias": np.zeros(filters),
        "out": rng.normal(0, 0.1, 2 * filters),
        "shift": np.zeros(1),
    }
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(sample) // batch)))  # small samples need more rounds
    steps = epochs * -(-len(sample) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(sample))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            symbols = np.concatenate([per_doc[i] for i in docs])
            row = np.repeat(np.arange(len(docs)), [len(per_doc[i]) for i in docs])
            n, y = len(docs), labels[docs]
            act = convolve(np.einsum("sd,wdf->wsf", p["embed"], p["filters"]).astype(np.float32), p["bias"].astype(np.float32), symbols)
            where = act.argmax(1)
            top = np.take_along_axis(act, where[:, None, :], 1)[:, 0, :]
            hidden = np.maximum(top, 0)
            most, mean = _pool(hidden, row, n)
            feats = np.concatenate([most, mean], 1)
            slope = (sigmoid(feats @ p["out"] + p["shift"]) - y) * weight[docs] / n
            grads = {"out": feats.T @ slope + 1e-3 * p["out"], "shift": np.array([slope.sum()])}
            back = slope[:, None] * p["out"][None, :]
            share_of = hidden == most[row]
            count = np.bincount(row, minlength=n)
            down = (back[row, :filters] * share_of / np.maximum(np.add.reduceat(share_of, np.searchsorted(row, np.arange(n)), axis=0), 1)[row] + back[row, filters:] / count[row][:, None]) * (top > 0)
            grads["bias"] = down.sum(0)
            g_embed, g_filters = 1e-5 * p["embed"], np.empty_like(p["filters"])
            lane = np.arange(filters)[None, :]
            for k in range(WIDTH):
                symbol = np.take_along_axis(symbols, STRIDE * where + k, 1).astype(np.int64)
                table = np.bincount((symbol * filters + lane).ravel(), down.ravel(), 512 * filters).reshape(512, filters)
                g_embed = g_embed + table @ p["filters"][k].T
                g_filters[k] = p["embed"].T @ table
            grads |= {"embed": g_embed, "filters": g_filters}
            step += 1
            now = rate * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] = p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    prior = min(max(share, 0.02), 0.98)  # classes weigh the same in training; the corpus has its own odds
    return Network(p["embed"], p["filters"], p["bias"].astype(np.float32), p["out"], float(p["shift"][0]) + float(np.log(prior / (1 - prior))))


def probabilities(net: Network, tables: np.ndarray, buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One probability per row; long rows go through the filters a few chunks at a time."""
    symbols, row = chunk_symbols(buffer, offsets)
    top = np.concatenate([np.maximum(convolve(tables, net.bias, symbols[i : i + 128]).max(1), 0) for i in range(0, len(symbols), 128)])
    most, mean = _pool(top, row, len(offsets) - 1)
    return sigmoid(np.concatenate([most, mean], 1) @ net.out + net.shift)


def fit(docs: DataFrame, labels: DataFrame, label: str, train_rows: Column, per_class: int = 1500, max_bytes: int = 6 << 20) -> tuple[Network | None, float]:
    """Trains on at most ``per_class`` documents and ``max_bytes`` of text of either class."""
    sample, share = labelled_sample(docs, labels, label, train_rows, per_class, max_bytes)
    return train(sample, share), share


def score(docs: DataFrame, model: tuple[Network | None, float], name: str = "score") -> DataFrame:
    """Adds the probability ``name`` to every row of ``docs``, which keeps its other columns.

    A null text scores as an empty one. Without a trained network (no labelled rows, or one class
    only) every row gets the share of label 1, 0.5 if there are none. A column that has the new
    one's name is replaced.
    """
    net, share = model
    docs = docs.drop(name)
    if net is None:
        return docs.withColumn(name, F.lit(float(share)))
    small = (net.embed, net.filters, net.bias, net.out, net.shift)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(*small)
        tables = own.tables()
        for batch in batches:
            buffer, offsets = buffer_of(batch.column(at))
            parts = [
                probabilities(own, tables, buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for a, b in blocks(offsets, 256 << 10)
            ]
            values = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
