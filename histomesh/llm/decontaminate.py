"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so that a question whose parameters were
changed keeps its template. Windows of template tokens are hashed; a bounded Bloom filter of the
benchmark's windows thins the documents' windows inside the scan, and the rest meets the benchmark
in a hash join. Windows on one alignment of a document with an item must agree on what stands in
the slots: one value of the item always becomes the same value in the document. Where they don't, the
value that most slots have holds, and the windows with another one are left out.

Names are told by their capitals. A second set of templates, in which names are plain words, finds
copies in other letter cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.llm.text import SpanHasher, blocks, buffer_of, mix, words
from histomesh.session import durable

_U = np.uint64
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
UNITS = (
    "%", "°", "°c", "°f", "$", "€", "£", "¢", "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "mg", "g", "kg", "t", "gram", "grams", "kilogram", "kilograms",
    "ton", "tons", "lb", "lbs", "oz", "pound", "pounds", "ounce", "ounces", "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degree", "degrees", "mph", "kmh", "km/h", "m/s", "hz", "khz", "mhz", "ghz",
    "w", "kw", "mw", "v", "kv", "j", "kj", "cal", "kcal", "pa", "kpa", "bar", "k", "kb", "mb", "gb", "tb",
)
MARKS = mix(np.array([LITERAL, NUMBER, NAME, UNIT], _U) + _U(0x5EED))
_EDGE = np.zeros(256, bool)
_EDGE[list(b"\"'()[]{}<>,;:!?.|*#&_`~")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True


def _unit_hashes() -> np.ndarray:
    data = [u.encode() for u in UNITS]
    at = np.r_[0, np.cumsum([len(d) for d in data])]
    return np.sort(SpanHasher(np.frombuffer(b"".join(data), np.uint8))(at[:-1], at[1:]))


_UNIT_HASHES = _unit_hashes()


def template(buffer: np.ndarray, offsets: np.ndarray, names: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, kind, token hash, value hash) of the template tokens of all rows.

    A token is a word without its outer punctuation. One that begins with a digit (a sign or
    currency mark before it allowed) is a number; a known unit after a number is a unit;
    capitalised words that don't begin a sentence or a line are names, and neighbouring names are
    one (without ``names``, they are literals, word by word). Placeholders of a kind share a token
    hash; the value hash is that of what stands there, blanks between words aside.
    """
    low = buffer.copy()
    if len(low) > 1:  # À-Þ to à-þ; A-Z are folded by the hash itself
        tail = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][tail] += 0x20
    rows, starts, ends, _ = words(buffer, offsets)
    stop = np.zeros(len(starts), bool)
    if len(starts):
        stop = _STOP[buffer[ends - 1]]
    raw_starts, raw_ends = starts, ends
    starts, ends = starts.copy(), ends.copy()
    live = np.arange(len(starts))
    while len(live):
        live = live[(starts[live] < ends[live])]
        live = live[_EDGE[buffer[starts[live]]]]
        starts[live] += 1
    live = np.arange(len(starts))
    while len(live):
        live = live[(starts[live] < ends[live])]
        live = live[_EDGE[buffer[ends[live] - 1]]]
        ends[live] -= 1
    keep = np.flatnonzero(starts < ends)
    if not len(keep):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U), np.zeros(0, _U)
    lines = np.r_[0, np.cumsum(buffer == 10)]
    fresh = np.ones(len(rows), bool)  # begins a sentence, a line or a row
    fresh[1:] = (rows[1:] != rows[:-1]) | stop[:-1] | (lines[raw_starts[1:]] != lines[raw_ends[:-1]])
    rows, starts, ends, fresh = rows[keep], starts[keep], ends[keep], fresh[keep]
    hasher = SpanHasher(low)
    values = hasher(starts, ends)
    first = buffer[starts]
    second = buffer[np.minimum(starts + 1, len(buffer) - 1)]
    number = _DIGIT[first] | (_DIGIT[second] & np.isin(first, list(b"+-$")) & (ends - starts > 1))
    upper = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E)) | ((first == 0xD0) & (second >= 0x90) & (second <= 0xAF)) | ((first == 0xCE) & (second >= 0x91) & (second <= 0xA9))
    same_row = np.r_[False, rows[1:] == rows[:-1]]
    after_number = np.r_[False, number[:-1]] & same_row
    kind = np.where(number, NUMBER, np.where(after_number & np.isin(values, _UNIT_HASHES), UNIT, np.where(upper & ~fresh & names, NAME, LITERAL)))
    name = kind == NAME
    goes_on = name & np.r_[False, name[:-1]] & same_row
    head = np.flatnonzero(~goes_on)  # of each run of names, or the token itself
    step = np.arange(len(rows)) - head[np.cumsum(~goes_on) - 1]
    values = np.add.reduceat(np.where(step > 0, mix(values + step.astype(_U)), values), head)  # word by word
    kind = kind[head]
    return rows[head], kind, np.where(kind == LITERAL, values, MARKS[kind]), values


def windows(rows: np.ndarray, tokens: np.ndarray, kinds: np.ndarray, size: int, least_literals: int, names: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash) of the windows inside one row that hold enough literal tokens; the templates with
    and without ``names`` hash apart."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    literal = np.r_[0, np.cumsum(kinds == LITERAL)]
    at = np.flatnonzero((rows[:n] == rows[size - 1 :]) & (literal[size:] - literal[:-size] >= least_literals))
    value = np.full(len(at), size if names else size + (1 << 20), _U)
    for k in range(size):
        value = mix(value * _U(0x9E3779B97F4A7C15) + tokens[at + k])
    return at, value


def _least(size: int) -> int:
    return (size + 1) // 2


_SLOTS = pa.list_(pa.struct([("place", pa.int32()), ("value", pa.int64())]))
_WINDOW = "named boolean, size int, place int, window bigint, slots array<struct<place:int,value:bigint>>"


def _slots(at: np.ndarray, size: int, kinds: np.ndarray, values: np.ndarray, places: np.ndarray) -> list[list[dict]]:
    """Per window its placeholder tokens: their place in the row and what stands there."""
    slot = np.flatnonzero(kinds != LITERAL)
    lo, hi = np.searchsorted(slot, at), np.searchsorted(slot, at + size)
    signed = values.view(np.int64)
    return [[{"place": int(places[j]), "value": int(signed[j])} for j in slot[a:b]] for a, b in zip(lo, hi)]


def item_windows(benchmark: DataFrame, size: int = 8, least_tokens: int = 5) -> DataFrame:
    """(item_id, n_windows, named, size, place, window, slots): all windows of every item, of its template
    with names and of that without. An item shorter than ``size`` is one window as a whole; under
    ``least_tokens`` it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffer, offsets = buffer_of(batch.column(1))
            ids = batch.column(0).to_pylist()
            for named in (True, False):
                rows, kinds, tokens, values = template(buffer, offsets, named)
                first = np.searchsorted(rows, np.arange(len(ids) + 1))
                for i, item in enumerate(ids):
                    a, b = first[i], first[i + 1]
                    width = min(size, b - a)
                    if width < least_tokens:
                        continue
                    at, hashes = windows(rows[a:b], tokens[a:b], kinds[a:b], width, _least(width), named)
                    if not len(at):
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(at), pa.int64()), pa.array([len(at)] * len(at), pa.int32()), pa.array([named] * len(at)), pa.array([width] * len(at), pa.int32()), pa.array(at, pa.int32()),
                         pa.array(hashes.view(np.int64)), pa.array(_slots(at, width, kinds[a:b], values[a:b], np.arange(b - a)), _SLOTS)],
                        ["item_id", "n_windows", "named", "size", "place", "window", "slots"],
                    )

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, "item_id bigint, n_windows int, " + _WINDOW)


def bloom_filter(hashes: DataFrame, max_bits: int = 28) -> np.ndarray:
    """Bits of a two-probe Bloom filter over column ``window``: 32 a value, at most 2 ** ``max_bits``."""
    n = hashes.count()
    bits = min(max_bits, max(16, int(n * 32).bit_length()))
    mask = (1 << bits) - 1
    word = lambda shift: F.shiftrightunsigned("window", shift).bitwiseAND(F.lit(mask))
    probes = hashes.select(F.explode(F.array(word(0), word(64 - bits))).alias("bit"))
    filled = probes.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[filled.column("word").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    return out


def _maybe(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = len(bloom).bit_length() - 1 + 6
    mask = _U((1 << bits) - 1)
    hit = np.ones(len(hashes), bool)
    for probe in (hashes & mask, (hashes >> _U(64 - bits)) & mask):
        hit &= (bloom[probe >> _U(6)] >> (probe & _U(63))) & _U(1) == 1
    return hit


def document_windows(docs: DataFrame, bloom: np.ndarray, sizes: list[int]) -> DataFrame:
    """Windows of the documents that pass the filter, with their slots."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)  # at most 2 ** max_bits bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            buffer, offsets = buffer_of(batch.column(1))
            ids = np.array(batch.column(0).to_pylist(), object)
            for a, b in blocks(offsets, 1 << 20):
                for named in (True, False):
                    rows, kinds, tokens, values = template(buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], named)
                    places = np.arange(len(rows)) - np.searchsorted(rows, rows)
                    for size in sizes:
                        at, hashes = windows(rows, tokens, kinds, size, _least(size), named)
                        hit = _maybe(own, hashes)
                        at, hashes = at[hit], hashes[hit]
                        if len(at):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(ids[a + rows[at]], pa.int64()), pa.array(np.full(len(at), named)), pa.array(np.full(len(at), size), pa.int32()), pa.array(places[at], pa.int32()),
                                 pa.array(hashes.view(np.int64)), pa.array(_slots(at, size, kinds, values, places), _SLOTS)],
                                ["doc_id", "named", "size", "place", "window", "slots"],
                            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, " + _WINDOW)


def _consistent(pairs: Column) -> Column:
    """Of the slot pairs (with repeats), those that hold: of the pairs of one of the item's values the most
    frequent, of equally frequent ones the unchanged, then the smallest."""
    counted = F.transform(F.array_distinct(pairs), lambda p: F.struct(
        p["theirs"].alias("theirs"), F.size(F.filter(pairs, lambda q: q == p)).alias("n"), (p["theirs"] == p["ours"]).cast("int").alias("same"), (-p["ours"]).alias("least"), p.alias("pair")
    ))
    rank = lambda c: F.struct(c["n"], c["same"], c["least"])
    held = lambda all_: F.filter(all_, lambda c: ~F.exists(all_, lambda o: (o["theirs"] == c["theirs"]) & (rank(o) > rank(c))))
    # the lambda holds the counts, so that they are worked out once
    return F.element_at(F.transform(F.array(counted), lambda all_: F.transform(held(all_), lambda c: c["pair"])), 1)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 8, least_tokens: int = 5, least_coverage: float = 0.5, least_verbatim: int = 20) -> DataFrame:
    """One row per document and item that the document gives away.

    Columns: doc_id, item_id, n_windows (the item's), matched (of them, with slots that hold on
    their alignment), coverage, verbatim (of them, the most on one alignment whose slots are unchanged),
    n_slots (different slot values met), slots_changed (of them, with another value in the
    document), reparameterised. Of the templates with and without names the one that covers more
    counts. An item counts from a coverage of ``least_coverage`` or from ``least_verbatim`` verbatim windows on.
    Null and empty texts match nothing; rows that share a doc_id count as one document; repeated
    items give their rows once; extra columns are ignored.
    """
    spark = docs.sparkSession
    items = durable(item_windows(benchmark, size, least_tokens))
    sizes = [r[0] for r in items.select("size").distinct().orderBy("size").collect()]  # at most ``size`` values
    empty = "doc_id bigint, item_id bigint, n_windows int, matched bigint, coverage double, verbatim bigint, n_slots bigint, slots_changed bigint, reparameterised boolean"
    if not sizes:
        return spark.createDataFrame([], empty)
    theirs = items.select("item_id", "n_windows", "named", "size", F.col("place").alias("item_place"), "window", F.col("slots").alias("item_slots")).distinct()
    met = document_windows(docs, bloom_filter(items), sizes).join(theirs, ["named", "window", "size"])
    pairs = F.transform(F.arrays_zip("item_slots", "slots"), lambda z: F.struct(z["item_slots"]["value"].alias("theirs"), z["slots"]["value"].alias("ours")))
    met = met.withColumn("shift", F.col("place") - F.col("item_place")).withColumn("pairs", pairs)
    # an alignment holds one window per place of the item at most
    lines = met.groupBy("doc_id", "item_id", "n_windows", "named", "shift").agg(F.collect_set(F.struct(F.col("item_place").alias("place"), "pairs")).alias("met"))
    lines = lines.withColumn("held", _consistent(F.flatten(F.transform("met", lambda w: w["pairs"]))))
    steady = lambda w: F.forall(w["pairs"], lambda p: (p["theirs"] == p["ours"]) | F.array_contains("held", p))
    kept = lines.withColumn("met", F.filter("met", steady))
    met_pairs = F.array_distinct(F.flatten(F.transform("met", lambda w: w["pairs"])))
    kept = kept.select(
        "doc_id", "item_id", "n_windows", "named",
        F.transform("met", lambda w: w["place"]).alias("places"),
        F.size(F.array_distinct(F.transform(F.filter("met", lambda w: F.forall(w["pairs"], lambda p: p["theirs"] == p["ours"])), lambda w: w["place"]))).alias("verbatim"),
        F.size(F.array_distinct(F.transform(met_pairs, lambda p: p["theirs"]))).alias("n_slots"),
        F.size(F.array_distinct(F.transform(F.filter(met_pairs, lambda p: p["theirs"] != p["ours"]), lambda p: p["theirs"]))).alias("changed"),
    )
    found = kept.groupBy("doc_id", "item_id", "n_windows", "named").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("matched"),
        F.max("verbatim").cast("long").alias("verbatim"), F.max("n_slots").cast("long").alias("n_slots"), F.max("changed").cast("long").alias("slots_changed"),
    )
    found = found.withColumn("coverage", F.col("matched") / F.col("n_windows")).filter((F.col("coverage") >= least_coverage) | (F.col("verbatim") >= least_verbatim))
    columns = ["n_windows", "matched", "coverage", "verbatim", "n_slots", "slots_changed"]
    # the template with names goes first where both cover as much
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "named", F.struct(*columns).alias("row"))).alias("b"))
    return best.select("doc_id", "item_id", *[F.col(f"b.row.{c}").alias(c) for c in columns], (F.col("b.row.slots_changed") > 0).alias("reparameterised"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that give no item away, with all their columns."""
    found = durable(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_id")).distinct())
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]), "left_anti")
