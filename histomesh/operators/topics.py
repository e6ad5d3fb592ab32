"""Topic model of count vectors by online variational Bayes; equal vectors are one row with a weight.

The update is that of Spark's ``LDA`` (full or drawn batches, learning rate ``(1024 + round) ** -0.51``, topic
weights estimated along). A round is one pass over the different vectors; tasks send topics x terms sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.session import durable, release, spread

SETTLED = 1e-3  # mean change of a vector's topic weights at which its steps end
AT_ONCE = 1 << 12  # vectors in a block


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the logarithm of the gamma function, for positive numbers."""
    x = np.asarray(x, float)
    y = 1 / (x + 6)
    z = y * y
    tail = z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    return np.log(x + 6) - y / 2 - tail - sum(1 / (x + i) for i in range(6))


def trigamma(x: np.ndarray) -> np.ndarray:
    """Second derivative of the logarithm of the gamma function, for positive numbers."""
    x = np.asarray(x, float)
    y = 1 / (x + 6)
    z = y * y
    tail = y * (1 + y / 2 + z * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30))))
    return tail + sum(1 / (x + i) ** 2 for i in range(6))


def expected_logs(weights: np.ndarray) -> np.ndarray:
    """Expected logarithms of the shares, per row of Dirichlet weights."""
    return digamma(weights) - digamma(weights.sum(-1, keepdims=True))


def _raised(x: np.ndarray) -> np.ndarray:
    """``exp(digamma(x))``: the recurrence over six steps as one fraction, no logarithm."""
    u, y = x * (x + 5), 1 / (x + 6)
    steps = (2 * x + 5) * ((3 * u + 20) * u + 24) / (u * (u + 4) * (u + 6))
    z = y * y
    tail = z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    return (x + 6) * np.exp(-(y / 2 + tail + steps))


def topic_weights(x: np.ndarray, terms: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Dirichlet weights (rows x topics) of the topics of each vector; ``terms`` are exponents of expected logarithms."""
    k, flat = len(alpha), np.ascontiguousarray(x.T)  # a column per vector
    start = lambda rows: alpha[:, None] + np.repeat(rows.sum(0, keepdims=True) / k, k, axis=0)
    out, waits = np.empty((len(x), k)), min(len(x), AT_ONCE)
    at, own, old = np.arange(waits), flat[:, :waits], start(flat[:, :waits])
    moving = np.ones(waits, bool)
    while len(at):
        shares = _raised(old)  # a factor for all topics of a vector cancels out
        new = alpha[:, None] + shares * (terms @ (own / (terms.T @ shares + 1e-100)))
        done = moving & (np.abs(new - old).sum(0) <= SETTLED * k)
        if done.any():
            out[at[done]] = new[:, done].T
            moving &= ~done
        old = new
        if 8 * moving.sum() <= 7 * len(at):  # settled vectors make room for others
            more = slice(waits, waits + AT_ONCE - int(moving.sum()))
            waits = min(len(x), more.stop)
            own, old = np.hstack([own[:, moving], flat[:, more]]), np.hstack([old[:, moving], start(flat[:, more])])
            at = np.concatenate([at[moving], np.arange(more.start, waits)])
            moving = np.ones(len(at), bool)
    return out


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    if not (np.isfinite(values).all() and (values >= 0).all()):
        raise ValueError("a topic model needs finite counts of 0 or more")
    return values


def _drawn(weights: np.ndarray, draws: np.ndarray, fraction: float, seed: int, turn: int) -> np.ndarray:
    """How many of the rows behind each vector are in the batch of a round."""
    if fraction >= 1:
        return weights
    return np.array([np.random.default_rng([seed, turn, d & (2**63 - 1)]).binomial(w, fraction) for w, d in zip(weights.tolist(), draws.tolist())], float)


def weighted_vectors(rows: DataFrame) -> DataFrame:
    """``(x, n, draw)``: the different vectors of column ``x``, how many rows have them, a hash; stored."""
    return durable(spread(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.xxhash64("x").alias("draw")), ["x"]))


def fit(vectors: DataFrame, width: int, k: int, rounds: int, fraction: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Exponents of the topics' expected log shares of terms (k x ``width``), and the topic weights."""
    rng = np.random.default_rng(seed)
    topics, alpha = rng.gamma(100, 1 / 100, (k, width)), np.full(k, 1 / k)
    total = vectors.agg(F.sum("n")).first()[0] or 0
    for turn in range(1, rounds + 1):
        terms, prior = np.exp(expected_logs(topics)), alpha.copy()

        def step(batches, terms=terms, prior=prior, turn=turn):
            stats, logs, n = np.zeros((k, width)), np.zeros(k), 0.0
            for batch in batches:
                x = _vectors(batch, width)
                w = _drawn(batch.column("n").to_numpy(), batch.column("draw").to_numpy(), fraction, seed, turn)
                some = (w > 0) & (x.sum(1) > 0)
                x, w = x[some], w[some].astype(float)
                logged = expected_logs(topic_weights(x, terms, prior))
                shares = np.exp(logged)
                stats += (shares * w[:, None]).T @ (x / (shares @ terms + 1e-100))
                logs += w @ logged
                n += w.sum()
            yield pa.RecordBatch.from_pydict({"stats": pa.array([stats.ravel().tolist()]), "logs": pa.array([logs.tolist()]), "n": [n]})

        parts = vectors.mapInArrow(step, "stats array<double>, logs array<double>, n double").collect()  # one row a task
        n = sum(p.n for p in parts)
        if not n:
            continue
        rate = (1024 + turn) ** -0.51
        stats = np.sum([p.stats for p in parts], axis=0).reshape(k, width) * terms
        topics = (1 - rate) * topics + rate * (stats * (total / np.ceil(fraction * total)) + 1 / k)
        slope = n * (np.sum([p.logs for p in parts], axis=0) / n - expected_logs(alpha))
        bend = -n * trigamma(alpha)
        change = -(slope - (slope / bend).sum() / (1 / (n * trigamma(alpha.sum())) + (1 / bend).sum())) / bend
        if (alpha + rate * change > 0).all():
            alpha = alpha + rate * change
    return np.exp(expected_logs(topics)), alpha


def proportions(vectors: DataFrame, terms: np.ndarray, alpha: np.ndarray) -> DataFrame:
    """``(x, topics)``: each vector's topic shares; zeros for a vector without counts."""

    def run(batches):
        for batch in batches:
            x = _vectors(batch, terms.shape[1])
            weights = topic_weights(x, terms, alpha) * (x.sum(1, keepdims=True) > 0)
            shares = weights / np.maximum(weights.sum(1, keepdims=True), 1e-300)
            yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array(list(shares), pa.list_(pa.float64()))], ["x", "topics"])

    return vectors.mapInArrow(run, "x array<double>, topics array<double>")


def fitted(rows: DataFrame, width: int, k: int, rounds: int, fraction: float, seed: int) -> DataFrame:
    """``rows`` with ``topics`` in place of the vector ``x``."""
    vectors = weighted_vectors(rows)
    found = durable(proportions(vectors, *fit(vectors, width, k, rounds, fraction, seed)))
    release(vectors)
    return rows.join(found, "x").drop("x")
