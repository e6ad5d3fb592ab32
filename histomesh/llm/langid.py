"""Language identification by interpolated Kneser-Ney character models.

Four-grams of letters (lower case; every run of other characters is one blank) are counted over
all training documents in Spark. The models of all languages are stored in arrays sorted by the
gram's hash, with one column of log-probabilities per language, so that one binary search serves
every language; grams no language has seen back off to shorter ones. The language with the lowest
cross-entropy per character wins; documents whose best cross-entropy is above what training
documents of that language show are marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from histomesh.llm.text import blocks, buffer_of, mix
from histomesh.operators.order import quantiles
from histomesh.session import durable

ORDER = 4
BITS = 16
UNDETERMINED = "und"
SCORED = "lang_pred string, score double, cross_entropy double, rejected boolean"
_U = np.uint64


@cache
def symbol_table() -> np.ndarray:
    """Code point -> lower-case letter in 16 bits (0: no letter). Letters beyond 0xFFFF share codes of the private area."""
    out = np.zeros(0x110000, np.uint16)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low if low < 0x10000 else 0xE000 + low % 0x1900
    return out


def grams(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, four-gram packed into 64 bits) of every kept character, and whether a row has a letter.

    Every row stands alone: it begins after blanks and is closed by one.
    """
    n = len(offsets) - 1
    points = np.frombuffer(buffer.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    leads = np.r_[0, np.cumsum((buffer & 0xC0) != 0x80)]
    row = np.repeat(np.arange(n), np.diff(leads[offsets]))
    symbols = symbol_table()[points]
    blank = symbols == 0
    after_blank = np.r_[True, blank[:-1]] if len(blank) else blank
    if len(row):
        after_blank |= np.r_[True, row[1:] != row[:-1]]
    keep = ~(blank & after_blank)
    symbols, row = symbols[keep], row[keep]
    count = np.bincount(row, minlength=n)
    letters = np.bincount(row[symbols != 0], minlength=n) > 0
    # each row: ORDER - 1 blanks, its symbols, one blank (dropped if it ends in one)
    begin = np.cumsum(count + ORDER) - (count + ORDER)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count) + ORDER - 1
    laid = np.zeros(int((count + ORDER).sum()), np.uint64)
    laid[place] = symbols
    packed = laid.copy()
    for k in range(1, ORDER):
        packed[k:] |= laid[:-k] << _U(BITS * k)
    last = begin + ORDER - 1 + count
    ends_blank = np.zeros(n, bool)
    some = count > 0
    ends_blank[some] = laid[last[some] - 1] == 0
    closing = np.flatnonzero(some & ~ends_blank)
    at = np.concatenate([place, last[closing]])
    who = np.concatenate([row, closing])
    order = np.argsort(at, kind="stable") if len(closing) else slice(None)
    return who[order], packed[at[order]], letters


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``docs`` with a lang; each task sums before it sends."""
    data = docs.filter(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            buffer, offsets = buffer_of(batch.column(0))
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b in blocks(offsets, 1 << 20):
                row, packed, _ = grams(buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for lang in set(langs[a:b]):
                    mine = packed[(langs[a:b] == lang)[row]]
                    held.setdefault(lang, []).append(np.unique(mine, return_counts=True))
                    if sum(len(k) for k, _ in held[lang]) > 1 << 21:
                        keys, n = merged(held[lang])
                        held[lang] = [(keys, n)]
                        if len(keys) > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
                            held[lang] = []
        for lang, parts in held.items():
            if parts:
                keys, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return data.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """Sorted gram hashes and, per language, a value for each."""

    hashes: np.ndarray
    values: np.ndarray

    def find(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(packed), np.int64), np.zeros(len(packed), bool)
        hashes = mix(packed)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


@dataclass
class Models:
    langs: list[str]
    grams: list[Table]  # log p of the 1-grams, 2-grams, ...
    backoff: list[Table]  # log weight of the lower order after a history of 0, 1, ... letters
    unseen: float
    limits: np.ndarray | None = None  # highest cross-entropy that isn't rejected

    def log_p(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """grams x languages, in float32."""
        if order == 0:
            return np.full((len(packed), len(self.langs)), self.unseen, np.float32)
        packed = packed & _U((1 << (BITS * order)) - 1)
        at, hit = self.grams[order - 1].find(packed)
        out = self.grams[order - 1].values[at] if len(self.grams[order - 1].hashes) else np.empty((len(packed), len(self.langs)), np.float32)
        miss = np.flatnonzero(~hit)
        if len(miss):
            lower = self.log_p(packed[miss], order - 1)
            at, known = self.backoff[order - 1].find(packed[miss] >> _U(BITS))
            if len(self.backoff[order - 1].hashes):
                lower += np.where(known[:, None], self.backoff[order - 1].values[at], 0)
            out[miss] = lower
        return out


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models from per-language (gram, count) arrays of the highest order.

    Lower orders use continuation counts (distinct left neighbours). The discount of an order is
    n1 / (n1 + 2 n2). A history that a language has not seen passes on to the lower order.
    """
    langs = sorted(counts)
    alphabet = 1 + len({int(k) for g, _ in counts.values() for k in np.unique(g & _U((1 << BITS) - 1))})
    per_lang = []
    for lang in langs:
        order = np.argsort(counts[lang][0])
        keys, n = counts[lang][0][order], counts[lang][1][order].astype(float)
        levels = []
        for size in range(ORDER, 0, -1):
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            history, first = np.unique(keys >> _U(BITS), return_index=True)
            total = np.add.reduceat(n, first) if len(first) else np.zeros(0)
            kinds = np.diff(np.r_[first, len(keys)])
            levels.insert(0, (keys, n, discount, history, total, discount * kinds / np.maximum(total, 1)))
            keys, n = np.unique(keys & _U((1 << (BITS * (size - 1))) - 1), return_counts=True)
            n = n.astype(float)
        per_lang.append(levels)

    def p(levels: list, packed: np.ndarray, size: int) -> np.ndarray:
        if size == 0:
            return np.full(len(packed), 1 / alphabet)
        keys, n, discount, history, total, weight = levels[size - 1]
        packed = packed & _U((1 << (BITS * size)) - 1)
        lower, before = p(levels, packed, size - 1), packed >> _U(BITS)
        seen = _lookup(history, total, before)
        direct = np.maximum(_lookup(keys, n, packed) - discount, 0) / np.maximum(seen, 1)
        return np.where(seen > 0, direct + _lookup(history, weight, before) * lower, lower)

    def table(keys: np.ndarray, columns: list[np.ndarray]) -> Table:
        hashes = mix(keys)
        order = np.argsort(hashes)
        return Table(hashes[order], np.stack(columns, 1).astype(np.float32)[order])

    grams_, backoff = [], []
    for size in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([levels[size - 1][0] for levels in per_lang]))
        grams_.append(table(keys, [np.log(p(levels, keys, size)) for levels in per_lang]))
        history = np.unique(np.concatenate([levels[size - 1][3] for levels in per_lang]))
        columns = []
        for levels in per_lang:
            weight = _lookup(levels[size - 1][3], levels[size - 1][5], history)
            columns.append(np.log(np.where(weight > 0, weight, 1.0)))
        backoff.append(table(history, columns))
    return Models(langs, grams_, backoff, float(np.log(1 / alphabet)))


def entropies(models: Models, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropy per character (rows x languages), characters per row, and whether a row has a letter."""
    n = len(offsets) - 1
    row, packed, letters = grams(buffer, offsets)
    out, size = np.zeros((n, len(models.langs))), np.bincount(row, minlength=n)
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        parts = [models.log_p(packed[i : i + (1 << 18)]) for i in range(0, len(packed), 1 << 18)]
        out[row[first]] = -np.add.reduceat(np.concatenate(parts), first, axis=0, dtype=np.float64)
    return out / np.maximum(size, 1)[:, None], size, letters


def fit(docs: DataFrame, train_rows: Column, quantile: float = 0.995, slack: float = 0.1) -> Models | None:
    """Models from all documents that satisfy ``train_rows`` and have a lang; None if there are none.

    Every four-gram counts, so the model, which the driver and every task hold, grows with the number
    of different four-grams. The rejection limit of a language is a quantile over all training
    documents that the models give it, or over those of all languages if it has fewer than 20.
    """
    known = docs.filter(train_rows)
    counted = durable(count_grams(known))
    table = counted.toArrow()
    langs = np.array(table.column("lang").to_pylist(), object)
    packed, n = table.column("gram").to_numpy().astype(np.int64).view(np.uint64), table.column("n").to_numpy()
    if not len(langs):
        return None
    models = kneser_ney({lang: (packed[langs == lang], n[langs == lang]) for lang in set(langs)})
    models.limits = np.full(len(models.langs), np.inf)
    found = predict(known.filter(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text")), models, reject=False)
    scored = durable(found.filter(F.col("cross_entropy").isNotNull()).select("lang_pred", "cross_entropy"))
    sizes = {r["lang_pred"]: r["n"] for r in scored.groupBy("lang_pred").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    own = {r["lang_pred"]: r["q"] for r in quantiles(scored, ["lang_pred"], "cross_entropy", {"q": quantile}).collect()}
    if any(sizes.get(lang, 0) < 20 for lang in models.langs) and sizes:
        pooled = quantiles(scored, [], "cross_entropy", {"q": quantile}).first()["q"]
        own = {lang: own[lang] if sizes.get(lang, 0) >= 20 else pooled for lang in models.langs}
    models.limits = np.array([own.get(lang, np.inf) * (1 + slack) for lang in models.langs])
    return models


def predict(docs: DataFrame, models: Models | None, reject: bool = True, certainty: float = 0.25) -> DataFrame:
    """Adds lang_pred, score, cross_entropy and rejected to every row of ``docs``.

    ``und`` with score 0 for a null text, one without a letter, or if there is no model; with
    ``reject`` also for rejected documents. The score is the chosen language's share of
    exp(-certainty * characters * cross-entropy). Ties go to the first language by name. Columns
    that have the new ones' names are replaced.
    """
    names = ["lang_pred", "score", "cross_entropy", "rejected"]
    docs = docs.drop(*names)
    schema = StructType([*docs.schema.fields, *_parse_datatype_string(SCORED).fields])
    at = docs.columns.index("text")
    if models is None:
        return docs.select("*", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(models)  # grows with the different four-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        langs = np.array([*own.langs, UNDETERMINED], object)
        for batch in batches:
            buffer, offsets = buffer_of(batch.column(at))
            parts = [entropies(own, buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets, 1 << 19)]
            values, size, letters = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros((0, len(own.langs))), np.zeros(0), np.zeros(0, bool))
            best = values.argmin(1)
            lowest = values.min(1) if len(values) else np.zeros(0)
            share = 1 / np.exp(-certainty * size[:, None] * (values - lowest[:, None])).sum(1)
            rejected = letters & (lowest > own.limits[best])
            undetermined = ~letters | (rejected & reject)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(langs[np.where(undetermined, len(own.langs), best)], pa.string()),
                    pa.array(np.where(letters, share, 0.0)),
                    pa.array(lowest, mask=~letters),
                    pa.array(rejected),
                ],
                [*batch.schema.names, *names],
            )

    return docs.mapInArrow(run, schema)
