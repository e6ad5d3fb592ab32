"""Near-duplicate lines by an exact set-similarity join, with DataFrame functions only.

A line is the set of its lower-case words. Words are ordered by rarity (a table of hashed counts over
the whole corpus; equal counts by hash). Two sets with a Jaccard similarity of t or more share one of
their first ``n - ceil(t n) + 1`` words (prefix filter), have sizes within t (length filter), can
still reach the overlap behind the places of the shared word (positional filter), and differ in
at most ``(1 - t) / (1 + t)`` of both sizes, which a parity map of the words (64, 128 or 256 bits by
their number) bounds from below. A semi-join on prefix words finds the lines that have any partner left;
it gives each line once, however many partners it has. Only their words are read again, for the exact test.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.session import durable, release

BUCKETS = 1 << 16
ROUNDS = 3
PARITY = [f"w{k}" for k in range(4)]
SHORT, MIDDLE = 64, 160  # words up to which 64 and 128 bits of parity tell lines apart
FILTER_WORDS = 1 << 16
ODD_BLANKS = "\t\x0b\x0c\r"


def _spaced(text: Column, blanks: str = ODD_BLANKS) -> Column:
    """Lower case, with other blanks as spaces; the replacement runs only on texts that hold one,
    since splitting at a single character is several times faster than at a pattern."""
    odd = F.lit(False)
    for c in blanks:
        odd = odd | F.contains(text, F.lit(c))
    return F.lower(F.when(odd, F.translate(text, blanks, " " * len(blanks))).otherwise(text))


def _words(line: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(_spaced(line), " "), ""))


def _word_hashes(line: Column) -> Column:
    """Hashes of the different words."""
    hashes = F.transform(F.split(_spaced(line), " "), lambda w: F.xxhash64(w))
    return F.array_distinct(F.array_remove(hashes, F.xxhash64(F.lit(""))))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line, body): the lines of every text with an id, numbered from 0."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    return texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))


def _identity(line: Column) -> list[Column]:
    """A line's text as 96 bits."""
    return [F.xxhash64(line).alias("id"), F.hash(line).alias("id2")]


def rarity_levels(docs: DataFrame) -> Column:
    """Array of BUCKETS levels: twice the binary logarithm of how often words of a hash bucket occur.

    A constant of the size of BUCKETS, whatever the corpus.
    """
    lines = F.explode(F.split(F.col("text").cast("string"), "\n")).alias("body")  # a split keeps no whole text's words in memory
    words = docs.select(lines).select(F.explode(F.split(_spaced(F.col("body")), " ")).alias("word"))
    counts = words.groupBy(F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    levels = ["0"] * BUCKETS
    for r in counts.select("bucket", F.ceil(2 * F.log2("n")).alias("level")).collect():
        levels[r.bucket] = str(r.level)
    return F.split(F.lit(",".join(levels)), ",").cast("array<tinyint>")


def _prefix_size(n: Column, t: Fraction) -> Column:
    return n - F.ceil(n * t.numerator / t.denominator - 1e-9) + 1


def _parity(words: Column, n: Column | None = None) -> list[Column]:
    """w0, w1, ...: one parity map of 64, 128 or 256 bits, by the number of words ``n``, or of 256; what is not needed is 0."""
    zero = F.lit(0).cast("long")

    def part(k: int, of: int) -> Column:
        def flip(a: Column, w: Column) -> Column:
            own = F.lit(1).cast("long") if of == 1 else (F.shiftright(w, 6).bitwiseAND(F.lit(of - 1)) == k).cast("long")
            return a.bitwiseXOR(F.call_function("shiftleft", own, w.bitwiseAND(F.lit(63)).cast("int")))

        return F.aggregate(words, zero, flip) if k < of else zero

    def sized(k: int) -> Column:
        return part(k, 4) if n is None else F.when(n <= SHORT, part(k, 1)).when(n <= MIDDLE, part(k, 2)).otherwise(part(k, 4))

    return [sized(k).alias(w) for k, w in enumerate(PARITY)]


def line_sets(docs: DataFrame, t: Fraction, least_words: int, least_chars: int) -> DataFrame:
    """One row per different line of ``least_words`` or more words, or of ``least_chars`` characters with any:
    its first place, number of words, parity map, prefix (32 bits of each word's hash, rarest
    first; none for lines of fewer words, which are compared by their text only), and whether its text occurs again."""
    levels = rarity_levels(docs)
    order = F.transform(
        _word_hashes(F.col("body")),
        lambda h: F.shiftleft(F.get(levels, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8)),
    )

    def summary(s: Column) -> Column:
        prefix = F.transform(F.slice(s, 1, F.greatest(_prefix_size(F.size(s), t), F.lit(0)).cast("int")), lambda w: F.shiftright(F.shiftleft(w, 32), 32).cast("int"))
        return F.struct(F.size(s).alias("n"), *_parity(s, F.size(s)), prefix.alias("prefix"))

    # the lambda holds the sorted words, so that they are worked out once per line; a filter on their
    # number stands behind the aggregate, as Spark would push it down with a second copy of the work
    found = F.element_at(F.transform(F.array(F.sort_array(order)), summary), 1)
    lines = lines_of(docs).select("doc_id", "line", *_identity(F.col("body")), found.alias("found"), (F.length("body") >= least_chars).alias("long"))
    sets = lines.groupBy("id", "id2").agg(F.min(F.struct("doc_id", "line", "found")).alias("f"), F.first("long").alias("long"), (F.count(F.lit(1)) > 1).alias("repeated"))
    wordy = F.col("f.found.n") >= least_words
    prefix = F.when(wordy, F.col("f.found.prefix")).otherwise(F.array().cast("array<int>")).alias("prefix")
    sets = sets.filter(wordy | (F.col("long") & (F.col("f.found.n") > 0)))
    return durable(sets.select("id", "id2", F.struct("f.doc_id", "f.line").alias("place"), "f.found.n", *[f"f.found.{w}" for w in PARITY], prefix, "repeated"))


def _near_size(a: str, b: str, t: Fraction) -> Column:
    """Length filter on the columns ``n`` of two aliases."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (n * t.denominator >= m * t.numerator) & (m * t.denominator >= n * t.numerator)


def _reachable(a: str, b: str, t: Fraction) -> Column:
    """Positional filter on the columns ``n`` and ``at`` of two aliases: at the first word they share,
    nothing shared stands before, and an overlap of t / (1 + t) of both sizes is needed."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    return rest * (t.numerator + t.denominator) >= (n + m) * t.numerator


def _apart(a: str, b: str, sized: bool = False) -> Column:
    """Bits in which the parity maps differ; of maps ``sized`` by the number of words, the wider one is
    folded to the width of the other."""
    w = [F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}")) for w in PARITY]
    if not sized:
        return sum((F.bit_count(x) for x in w[1:]), F.bit_count(w[0]))
    fewer = F.least(F.col(f"{a}.n"), F.col(f"{b}.n"))
    even, odd = w[0].bitwiseXOR(w[2]), w[1].bitwiseXOR(w[3])
    widest = F.bit_count(w[0]) + F.bit_count(w[1]) + F.bit_count(w[2]) + F.bit_count(w[3])
    return F.when(fewer <= SHORT, F.bit_count(even.bitwiseXOR(odd))).when(fewer <= MIDDLE, F.bit_count(even) + F.bit_count(odd)).otherwise(widest)


def _close(a: str, b: str, t: Fraction, sized: bool = False) -> Column:
    """Parity filter on two aliases."""
    return _apart(a, b, sized) * (t.numerator + t.denominator) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (t.denominator - t.numerator)


def involved(sets: DataFrame, t: Fraction) -> DataFrame:
    """The rows of ``sets`` that some other line may match."""
    # in the order in which posexplode gives them: both sides of the self-join then have one exchange
    rows = sets.select("id", "n", *PARITY, F.posexplode("prefix").alias("at", "word"))
    a, b = rows.alias("a"), rows.alias("b")
    may = _near_size("a", "b", t) & _reachable("a", "b", t) & _close("a", "b", t, sized=True)
    met = a.hint("merge").join(b, (F.col("a.word") == F.col("b.word")) & (F.col("a.id") != F.col("b.id")) & may, "left_semi")
    ids = durable(met.groupBy("id").agg(F.count(F.lit(1)).alias("words")).select("id"))
    out = durable(_among(sets, ids, F.col("id")).join(ids, "id"))  # few rows of a wide table are moved
    release(ids)
    return out


def _held(df: DataFrame, rows: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with ``_held``: true for all rows whose ``columns`` are among those of ``rows``, and for few others: a filter
    of 2 ** 22 bits, whatever their number. It is a broadcast table, as plans would repeat a literal of that size."""
    at = F.xxhash64(*columns).bitwiseAND(F.lit(FILTER_WORDS * 64 - 1))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    bits = rows.groupBy(F.shiftright(at, 6).alias("_word")).agg(F.bit_or(mask).alias("_bits"))
    marked = df.withColumn("_mask", mask).withColumn("_own", F.shiftright(at, 6)).join(F.broadcast(bits), F.col("_own") == F.col("_word"), "left")
    found = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) != 0, F.lit(False)).alias("_held")
    return marked.select(*df.columns, found)


def _among(df: DataFrame, rows: DataFrame, *columns: Column) -> DataFrame:
    """The rows of ``df`` that ``_held`` marks."""
    return _held(df, rows, *columns).filter("_held").drop("_held")


def _confirmed(pairs: DataFrame, bodies: DataFrame, t: Fraction) -> DataFrame:
    """The later lines (id, id2) of ``pairs`` whose word sets reach the similarity."""
    side = lambda s: bodies.select(F.col("id").alias(f"{s}id"), F.col("id2").alias(f"{s}id2"), F.col("body").alias(f"{s}body"))
    both = pairs.join(side("l"), ["lid", "lid2"]).join(side("e"), ["eid", "eid2"])
    words = F.array(F.struct(_words(F.col("lbody")).alias("l"), _words(F.col("ebody")).alias("e")))

    def reaches(x: Column) -> Column:
        either = lambda c: F.size(x["l"]) + F.size(x["e"]) - c
        return F.exists(F.array(F.size(F.array_intersect(x["l"], x["e"]))), lambda c: c * t.denominator >= either(c) * t.numerator)

    # lambdas hold the words and the overlap, so that each is worked out once per pair
    return both.filter(F.exists(words, reaches)).select(F.col("lid").alias("id"), F.col("lid2").alias("id2")).distinct()


def _led(open_lines: DataFrame, pool: DataFrame, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """Pairs of an open line and the earliest line of ``pool`` that shares one of its last three prefix
    words, the least rare ones; and the leaders (word, id, id2) of those words."""
    last = lambda rows: rows.select("id", "id2", "n", "place", *PARITY, F.explode(F.slice("prefix", F.greatest(F.size("prefix") - 2, F.lit(1)), 3)).alias("word"))
    heads = last(pool).groupBy("word").agg(F.min(F.struct("place", "id", "id2", "n", *PARITY)).alias("h")).select("word", "h.*")
    l, e = last(open_lines).alias("l"), heads.alias("e")
    met = l.join(e, (F.col("l.word") == F.col("e.word")) & (F.col("e.place") < F.col("l.place")) & _near_size("l", "e", t) & _close("l", "e", t))
    best = met.groupBy(F.col("l.id").alias("lid"), F.col("l.id2").alias("lid2")).agg(F.min(F.struct(_apart("l", "e").alias("apart"), F.col("e.id").alias("eid"), F.col("e.id2").alias("eid2"))).alias("e"))
    return best.select("lid", "lid2", "e.eid", "e.eid2"), heads.select("id", "id2").distinct()


def similar_to_earlier(docs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """(id, id2) of the lines with a similar line whose first place is earlier.

    Of the lines that may match, each first meets leaders, in ROUNDS rounds: the closest of the earliest
    lines that share one of the last three words of both prefixes; a line leads in one round only, and
    only while nothing earlier resembles it. In a crowd of variants that settles nearly all. The
    lines still open meet all earlier ones, each at the first prefix word they share.
    """
    met_any = involved(sets, t)
    places = met_any.select("place.doc_id", "place.line")
    found = _among(lines_of(docs), places, F.col("doc_id"), F.col("line")).select(F.struct("doc_id", "line").alias("place"), "body")
    bodies = durable(found.join(met_any.select("id", "id2", "place"), "place").select("id", "id2", "body").dropDuplicates(["id", "id2"]))
    # few lines are left: 256 bits for each of them keep lines apart that just miss the threshold
    wide = bodies.withColumn("_hashes", _word_hashes(F.col("body"))).select("id", "id2", *_parity(F.col("_hashes")))
    known = durable(met_any.drop(*PARITY).join(wide, ["id", "id2"]))
    settled, still, pool = [], known, known
    for _ in range(ROUNDS):
        pairs, heads = _led(still, pool, t)
        settled.append(durable(_confirmed(pairs, bodies, t)))
        still = still.join(settled[-1], ["id", "id2"], "left_anti")
        pool = pool.join(settled[-1], ["id", "id2"], "left_anti").join(heads, ["id", "id2"], "left_anti")
    rows = lambda of: of.select("id", "id2", "place", "n", *PARITY, "prefix", F.explode("prefix").alias("word"))
    first = F.get(F.array_intersect("l.prefix", "e.prefix"), F.lit(0)) == F.col("l.word")
    same = (F.col("l.word") == F.col("e.word")) & (F.col("e.place") < F.col("l.place")) & _near_size("l", "e", t) & _close("l", "e", t) & first
    still = durable(still)
    earlier = _among(rows(known), still.select(F.explode("prefix").alias("word")), F.col("word"))
    met = rows(still).alias("l").join(earlier.alias("e"), same)
    names = [F.col(f"{s}.{c}").alias(s + c) for s in "le" for c in ("id", "id2")]
    ordered = durable(met.select(*names, _apart("l", "e").alias("apart")))
    # one partner settles a line: the closest is read first, the others only for lines it doesn't settle
    closest = ordered.groupBy("lid", "lid2").agg(F.min(F.struct("apart", "eid", "eid2")).alias("e"))
    settled.append(durable(_confirmed(closest.select("lid", "lid2", "e.eid", "e.eid2"), bodies, t)))
    done = settled[-1].select(F.col("id").alias("lid"), F.col("id2").alias("lid2"))
    third = _confirmed(ordered.join(done, ["lid", "lid2"], "left_anti").select("lid", "lid2", "eid", "eid2"), bodies, t)
    for more in settled:
        third = third.unionAll(more)
    out = durable(third.distinct())
    release(met_any, known, bodies, still, ordered, *settled)
    return out


def removed_lines(docs: DataFrame, threshold: Fraction | float = Fraction(4, 5), least_words: int = 5, least_chars: int = 20) -> DataFrame:
    """(doc_id, n_removed, removed): documents with lines that go, and those lines' numbers in order.

    Of the lines with ``least_words`` different words or more, in the order of (doc_id, line
    number), one goes if an earlier line has the same text or a set of words with a Jaccard
    similarity of ``threshold`` or more, whether that line itself goes or not. Of lines with fewer words
    (those of scripts without blanks, say), one of ``least_chars`` characters or more goes if an earlier
    line has the same text. Shorter lines stay.
    Rows with a null id or text take no part; rows that share a doc_id are one document: the same
    line at the same number is one line.
    """
    t = Fraction(threshold).limit_denominator(1000)
    sets = line_sets(docs, t, least_words, least_chars)
    gone = similar_to_earlier(docs, sets, t)
    # all places of a text that is gone go, and all but the first of one that occurs again; the others are not looked at
    nowhere = F.lit(None).cast(sets.schema["place"].dataType).alias("place")
    fate = durable(sets.filter("repeated").select("id", "id2", "place").unionAll(gone.select("id", "id2", nowhere)))
    release(sets, gone)
    places = lines_of(docs).select("doc_id", "line", *_identity(F.col("body")))
    later = (F.col("place.doc_id") != F.col("doc_id")) | (F.col("place.line") != F.col("line"))
    out = _among(places, fate, F.col("id"), F.col("id2")).join(fate, ["id", "id2"]).filter(F.col("place").isNull() | later)
    lines = out.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    return lines.select("doc_id", F.size("removed").cast("long").alias("n_removed"), "removed")


def report(docs: DataFrame, threshold: Fraction | float = Fraction(4, 5), least_words: int = 5, least_chars: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines (0 without a text), n_removed, removed."""
    gone = durable(removed_lines(docs, threshold, least_words, least_chars))
    n = F.coalesce(F.size(F.split(F.col("text").cast("string"), "\n")), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_lines"))
    out = rows.join(gone, "doc_id", "left")
    return out.select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def clean(docs: DataFrame, threshold: Fraction | float = Fraction(4, 5), least_words: int = 5, least_chars: int = 20, drop_spent: bool = False) -> DataFrame:
    """``docs`` without the lines of ``removed_lines``; all rows and columns stay, a null text too.

    With ``drop_spent``, a document goes that lost lines and has only blank lines left.
    """
    gone = durable(removed_lines(docs, threshold, least_words, least_chars))
    marked = _held(docs, gone, F.col("doc_id").cast("long"))
    whole, cut = (marked.filter(c).drop("_held") for c in ("not _held", "_held"))  # only texts that may change are moved
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("removed").alias("_removed"))
    joined = cut.join(gone, cut["doc_id"].cast("long") == F.col("_id"), "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    rest = F.filter(lines, lambda x, i: ~F.array_contains("_removed", i))
    if drop_spent:
        joined = joined.filter(F.col("_removed").isNull() | F.exists(rest, lambda x: F.size(_words(x)) > 0))
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("text")
    return whole.unionAll(joined.select(*[text if c == "text" else cut[c] for c in docs.columns]))
