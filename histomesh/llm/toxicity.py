"""Toxicity by multiple-instance learning.

Only whole documents are labelled; the instances are their sentences. A sentence's probability is
logistic, with weights of zero or more, in the words it holds and the beginnings of longer words; a document's is the noisy-or of
its sentences, ``1 - prod(1 - p)``. Training maximises the likelihood of the document labels with an
L1 penalty, on a bounded sample; the sentences that make a document toxic are located afterwards.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

from histomesh.llm.quality import sigmoid
from histomesh.llm.sample import labelled_sample

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
PREFIXES = range(4, 9)
CACHED_WORDS = 1 << 20
SCORED = "score double, n_sentences int, offending array<struct<start:int,end:int,score:double>>"


def features(word: str) -> list[str]:
    """The word itself, and the beginnings of 4 to 8 letters that it goes on after."""
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


class WordWeights(dict):
    """Summed weight of a word's features, kept for up to ``CACHED_WORDS`` words at a time."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        get = self.weights.get
        value = self[word] = sum(get(f, 0.0) for f in features(word))
        return value


def sentence_logits(text: str, weight_of: WordWeights, bias: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spans (code points) and logits of the sentences that hold a word."""
    spans, logits = [], []
    get = weight_of.__getitem__
    for m in SENTENCE.finditer(text):
        words = WORD.findall(m[0].lower())
        if words:
            spans.append(m.span())
            logits.append(bias + sum(map(get, words)))
    return spans, np.array(logits)


def noisy_or(logits: np.ndarray) -> float:
    """1 - prod(1 - sigmoid(z)), by way of sums of log(1 + e^z)."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


def train(sample: list[tuple[str, int]], share: float, least_docs: int = 3, least_z: float = 4.0, rounds: int = 500, rate: float = 0.05, l1: float = 2e-4) -> tuple[float, dict[str, float]] | None:
    """(bias, weights); None if the sample lacks one of the classes.

    Candidate features occur in ``least_docs`` documents and are over-represented in toxic ones by
    ``least_z`` standard errors.
    """
    y = np.array([label for _, label in sample])
    if len(y) == 0 or y.min() == y.max():
        return None
    made: dict[str, list[str]] = {}
    docs, seen = [], (Counter(), Counter())
    for text, label in sample:
        sentences, once = [], set()
        for m in SENTENCE.finditer(text):
            words = WORD.findall(m[0].lower())
            if words:
                for w in words:
                    if w not in made:
                        made[w] = features(w)
                sentences.append(words)
                once.update(words)
        docs.append(sentences)
        seen[label].update({f for w in once for f in made[w]})
    n1, n0 = int(y.sum()), int((1 - y).sum())
    chosen = {}
    for f, a in seen[1].items():
        b = seen[0][f]
        p = (a + b + 1) / (n1 + n0 + 2)
        if a + b >= least_docs and (a / n1 - b / n0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)) > least_z:
            chosen[f] = len(chosen)
    sentence, feature, doc = [], [], []
    for d, sentences in enumerate(docs):
        for words in sentences:
            hits = [chosen[f] for w in words for f in made[w] if f in chosen]
            sentence += [len(doc)] * len(hits)
            feature += hits
            doc.append(d)
    sentence, feature, doc = np.array(sentence, int), np.array(feature, int), np.array(doc, int)
    share = min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, share / n1, (1 - share) / n0)  # the corpus' own odds, whatever the sample's
    w, bias = np.zeros(len(chosen)), -5.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        z = np.clip(bias + np.bincount(sentence, w[feature], len(doc)), -30, 30)
        clear = np.exp(-np.bincount(doc, np.logaddexp(0, z), len(y)))
        pull = np.where(y == 1, -clear / np.maximum(1 - clear, 1e-6), 1.0) * weight
        slope = pull[doc] * sigmoid(z)
        g = np.r_[np.bincount(feature, slope[sentence], len(w)) + l1, slope.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = np.maximum(w - move[:-1], 0), bias - move[-1]
    return float(bias), {f: float(w[i]) for f, i in chosen.items() if w[i]}


def fit(docs: DataFrame, labels: DataFrame, label: str, train_rows: Column, per_class: int = 2500, max_bytes: int = 8 << 20) -> tuple[tuple | None, float]:
    """Trains on at most ``per_class`` documents and ``max_bytes`` of text of either class."""
    sample, share = labelled_sample(docs, labels, label, train_rows, per_class, max_bytes)
    return train(sample, share), share


def score(docs: DataFrame, model: tuple[tuple | None, float], locate: float = 0.3) -> DataFrame:
    """Adds score, n_sentences and the sentences with a probability of ``locate`` or more.

    A text without a word (null and empty ones too) has no sentence and scores 0. Without a
    trained model every row that has a sentence scores the share of label 1, and none is located.
    Columns that have the new ones' names are replaced; all other columns are kept.
    """
    fitted, share = model
    docs = docs.drop("score", "n_sentences", "offending")
    at = docs.columns.index("text")
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = fitted or (0.0, {})
        weight_of = WordWeights(weights)
        for batch in batches:
            scores, counts, found = [], [], []
            for value in batch.column(at):
                spans, z = sentence_logits(value.as_py() or "", weight_of, bias)
                counts.append(len(spans))
                if not spans or fitted is None:
                    scores.append(share if spans else 0.0)
                    found.append([])
                    continue
                scores.append(noisy_or(z))
                p = sigmoid(z)
                found.append([{"start": spans[i][0], "end": spans[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= locate)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(found, spans_type)],
                [*batch.schema.names, "score", "n_sentences", "offending"],
            )

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *_parse_datatype_string(SCORED).fields]))
