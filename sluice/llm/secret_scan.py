"""Secret scans in DataFrame functions alone: fixed patterns, and a battery of randomness tests for other long tokens.

A token's encoding is inferred from its characters. Under the hypothesis that its symbols are drawn evenly and
independently, three p-values are taken: chi-squared of the symbol counts (mean and variance exact for the token's
length), number of runs above and below the alphabet's middle, and serial correlation of neighbours. Three times the
least is the token's. Tokens of a length class (powers of two) are one family: Benjamini-Hochberg rejects, of each class,
those that are not random, with at most FALSE of the rejected expected to be random. What is left is reported. The p-values
are counted in bins, so that what the thresholds come from has a fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds that are always reported, in this order; the pattern, the group that counts and its least length.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
#: The kind of the tokens that the battery reports, after the others, and what a token is.
RANDOM, TOKEN = "random", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by the symbols that they may have, the first that fits holds: an alphabet of N symbols, letters and digits.
ENCODINGS = [DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER, DIGITS + UPPER + LOWER, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_"]
#: Share of random tokens among the rejected that is aimed at; bins of a power of ten of p, and their number.
FALSE, BINS_TEN, BINS = 0.05, 20, 600
#: Length classes: up to 2^5, 2^6, ... symbols; the last has all longer ones.
CLASSES = range(5, 13)
STEP = 256
#: Code points of a piece of a text that is cut at spans; a position beyond any text.
PIECE, FAR = 1024, 1 << 40


def _before(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each element of an array of longs, what stands before it combined, in steps of STEP elements: the copies that
    growing an array makes stay short."""
    grow = lambda a: F.aggregate(a, F.array(F.lit(zero).cast("long")), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))
    chunks = lambda a: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / STEP).cast("int") - 1, F.lit(0))), lambda k: F.slice(a, k * STEP + 1, F.lit(STEP)))
    # the array is bound once, so that no step makes it anew
    bound = lambda a, f: F.element_at(F.transform(F.array(a), f), 1)
    inner = lambda a: F.transform(chunks(a), grow)

    def whole(parts: Column) -> Column:
        outer = grow(F.transform(parts, lambda x: F.element_at(x, -1)))
        return F.flatten(F.zip_with(parts, F.slice(outer, F.lit(1), F.size(outer) - 1), lambda x, o: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda v: combine(v, o))))

    return bound(values, lambda a: bound(inner(a), whole))


def _running(sizes: Column) -> Column:
    """Sums of what stands before each element."""
    return _before(sizes, lambda a, b: a + b, 0)


def places(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches whose group is long enough, as structs of start, kind and end (code points) and
    the group's text. A split at the matches gives what lies between them, running sums give where they start."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, b: (F.length(a) + F.length(b)).cast("long"))
    ends = F.zip_with(_running(steps), steps, lambda a, b: a + b)
    each = F.zip_with(F.arrays_zip(ends.alias("end"), found.alias("all")), own, lambda x, g: F.struct((x["end"] - F.length(x["all"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), g.alias("value")))
    kept = F.filter(each, lambda x: F.length(x["value"]) >= least)
    none = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("end"), F.lit("").alias("value"))), lambda x: F.lit(False))
    # most texts have no match: their split is not made
    return F.when(F.regexp_like(text, F.lit(_long_enough(pattern, least) if not group else pattern)), kept).otherwise(none)


def _long_enough(pattern: str, least: int) -> str:
    """A pattern that holds for texts that may have a long enough match: the closing + becomes a count."""
    head = pattern.removesuffix("+")
    return f"{head}{{{max(1, least - (4 if head.startswith('AKIA') else 0))},}}" if pattern.endswith("+") else pattern


def _beyond(z: Column) -> Column:
    """P(N > z) for a standard normal N, z >= 0: a polynomial times the density (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def _upper(z: Column) -> Column:
    return F.when(z >= 0, _beyond(F.abs(z))).otherwise(1 - _beyond(F.abs(z)))


def battery(tokens: Column) -> Column:
    """Tokens (structs of start, kind, end, value) of a letter and a digit at least whose encoding is known, with ``p``."""
    known = F.filter(tokens, lambda x: F.regexp_like(x["value"], F.lit("[0-9]")) & F.regexp_like(x["value"], F.lit("[A-Za-z]")))

    def encoded(x: Column) -> Column:
        fits = None
        for a in ENCODINGS:
            test = F.translate(x["value"], a, "") == ""
            fits = F.when(test, F.lit(a)) if fits is None else fits.when(test, F.lit(a))
        return F.struct(x["start"], x["kind"], x["end"], x["value"], fits.alias("alphabet"))

    def counted(x: Column) -> Column:
        s, a = x["value"], x["alphabet"]
        n, k = F.length(s).cast("double"), F.length(a)
        symbols = F.filter(F.split(a, ""), lambda c: c != "")
        squares = F.aggregate(symbols, F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(s, c, F.lit(""))), F.lit(2)))
        high = F.translate(s, "", "")  # a copy; each symbol becomes 0 or 1 below
        bits = None
        for e in ENCODINGS:
            marks = "0" * (len(e) // 2) + "1" * (len(e) - len(e) // 2)
            bits = F.when(a == e, F.translate(high, e, marks)) if bits is None else bits.when(a == e, F.translate(high, e, marks))
        values = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(a, c).cast("double"))
        return F.struct(x["start"], x["kind"], x["end"], x["value"], n.alias("n"), k.cast("double").alias("k"), squares.alias("squares"), bits.alias("bits"), values.alias("values"))

    def summed(x: Column) -> Column:
        v, n = x["values"], x["n"]
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, y: acc + y)
        m = F.size(v) - 1
        products = F.zip_with(F.slice(v, F.lit(1), m), F.slice(v, F.lit(2), m), lambda a, b: a * b)
        return F.struct(
            x["start"], x["kind"], x["end"], x["value"], n, x["k"], x["squares"],
            (n - F.length(F.replace(x["bits"], F.lit("1"), F.lit("")))).alias("ones"),
            F.length(F.regexp_replace(x["bits"], F.lit("0+|1+"), F.lit("x"))).cast("double").alias("runs"),
            total(v).alias("sum"), total(F.transform(v, lambda y: y * y)).alias("sum2"), total(products).alias("sum_next"),
            F.element_at(v, 1).alias("first"), F.element_at(v, -1).alias("last"),
        )

    def judged(x: Column) -> Column:
        n, k = x["n"], x["k"]
        chi = x["squares"] * k / n - n
        mean = k - 1
        var = 2 * (k - 1) * (n - 1) / n
        d = 2 * mean * mean / var
        z = (F.pow(F.greatest(chi, F.lit(0.0)) / mean, F.lit(1 / 3)) - (1 - 2 / (9 * d))) / F.sqrt(2 / (9 * d))
        p_chi = _upper(z)
        zeros = n - x["ones"]
        expect = 2 * x["ones"] * zeros / n + 1
        spread = F.sqrt(F.greatest((expect - 1) * (expect - 2) / (n - 1), F.lit(1e-9)))
        p_runs = F.when((x["ones"] == 0) | (zeros == 0), F.pow(F.lit(0.5), n - 1)).otherwise(2 * _beyond(F.greatest(F.abs(x["runs"] - expect) - 0.5, F.lit(0.0)) / spread))
        centre = x["sum"] / n
        around = x["sum2"] - n * centre * centre
        next_ = x["sum_next"] - centre * (2 * x["sum"] - x["first"] - x["last"]) + (n - 1) * centre * centre
        p_serial = F.when(around <= 1e-9, F.pow(F.lit(0.5), n - 1)).otherwise(2 * _beyond(F.abs(next_ / F.greatest(around, F.lit(1e-9)) + 1 / (n - 1)) * F.sqrt(n - 1)))
        p = F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))
        return F.struct(x["start"], x["kind"], x["end"], x["value"], p.alias("p"), length_class(n).alias("length_class"), bin_of(p).alias("bin"))

    out = F.filter(F.transform(known, encoded), lambda x: x["alphabet"].isNotNull())
    for step in (counted, summed, judged):
        out = F.transform(out, step)
    return out


def length_class(n: Column) -> Column:
    return F.least(F.greatest(F.ceil(F.log2(n)).cast("int"), F.lit(CLASSES[0])), F.lit(CLASSES[-1]))


def bin_of(p: Column) -> Column:
    """Bin b holds p in (10^-((b+1)/BINS_TEN), 10^-(b/BINS_TEN)]; the last one all smaller."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_TEN).cast("int"), F.lit(BINS - 1))


def thresholds(texts: DataFrame) -> dict[int, int]:
    """For each length class the first bin that is rejected, from counts of all texts' tokens by class and bin."""
    each = texts.select(F.explode(battery(places(F.col("text"), RANDOM, TOKEN))).alias("t")).groupBy("t.length_class", "t.bin").count().collect()
    out = {}
    for c in CLASSES:
        count = {r.bin: r["count"] for r in each if r.length_class == c}
        total, below, first = sum(count.values()), 0, BINS
        for b in sorted(count, reverse=True):  # the smallest p first; a bin counts as its largest p
            below += count[b]
            if 10 ** (-b / BINS_TEN) <= FALSE * below / total:
                first = b
        out[c] = first
    return out


def scanned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their columns and ``base`` and ``spans``: arrays of (start, kind, end) by start, then kind as listed
    (``spans`` has the battery's tokens too, unless they overlap base ones).

    Null and empty texts have none. Rows stay as they are, repeated or with null ids; columns named base or spans are
    replaced. No shuffle but that of the counts; texts are read twice, for the counts and for the spans.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = thresholds(docs.select(text.alias("text")))
    limit = F.create_map(*[F.lit(x) for c, b in first.items() for x in (c, b)])
    order = {k: i for i, (k, *_) in enumerate([*KINDS, (RANDOM,)])}
    rank = lambda x: F.struct(x["start"].alias("start"), F.element_at(F.create_map(*[F.lit(y) for kv in order.items() for y in kv]), x["kind"]).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))
    names = [c for c in docs.columns if c not in ("base", "spans")]
    d = docs.select(*names, *[places(text, *kind).alias(f"kind_{i}_") for i, kind in enumerate(KINDS)], battery(places(text, RANDOM, TOKEN)).alias("tokens_"))
    base = F.sort_array(F.transform(F.concat(*[f"kind_{i}_" for i in range(len(KINDS))]), rank))
    d = d.select(*names, base.alias("base_"), "tokens_")
    random = F.transform(F.filter("tokens_", lambda t: t["bin"] < F.element_at(limit, t["length_class"])), rank)
    d = d.select(*names, "base_", random.alias("random_"))
    d = d.select(*names, "base_", F.when((F.size("base_") == 0) | (F.size("random_") == 0), F.concat("base_", "random_")).otherwise(apart(F.col("base_"), F.col("random_"), len(KINDS))).alias("all_"))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return d.select(*names, bare("base_").alias("base"), bare("all_").alias("spans"))


def apart(base: Column, others: Column, rank: int) -> Column:
    """Base spans and those of the others that overlap none, sorted; all others have this rank, higher ones than base
    spans. Spans in their order, with the furthest end of base spans before each and the next start after it: no pair is
    looked at, so the work grows with the number of spans."""

    def kept(each: Column) -> Column:
        ends = _before(F.transform(each, lambda x: F.when(x["rank"] < rank, x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), 0)
        starts = F.reverse(_before(F.reverse(F.transform(each, lambda x: F.when(x["rank"] < rank, x["start"]).otherwise(FAR))), lambda a, b: F.least(a, b), FAR))
        around = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("end"), s.alias("start")))
        both = F.zip_with(each, around, lambda x, y: F.struct(x.alias("x"), ((x["rank"] < rank) | (y["end"] <= x["start"]) & (x["end"] <= y["start"])).alias("ok")))
        return F.transform(F.filter(both, lambda z: z["ok"]), lambda z: z["x"])

    return F.element_at(F.transform(F.array(F.sort_array(F.concat(base, others))), kept), 1)


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping spans replaced by the mark. The text is cut into pieces of PIECE code
    points, so that finding a place takes a step of that size at most, and is put together once."""

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        """From code point a to b (end exclusive)."""
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        piece = lambda k: F.coalesce(F.try_element_at(pieces, k + 1), F.lit(""))
        upto = F.substring(piece(last), 1, F.pmod(b, F.lit(PIECE)).cast("int"))
        head = F.substring(piece(first), (F.pmod(a, F.lit(PIECE)) + 1).cast("int"), F.lit(PIECE))
        same = F.substring(piece(first), (F.pmod(a, F.lit(PIECE)) + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
        middle = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(first == last, same).otherwise(F.concat(head, middle, upto))

    def hidden(pieces: Column) -> Column:
        ends = _before(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b), 0)
        each = F.zip_with(spans, ends, lambda x, at: F.struct(x["start"].alias("start"), at.alias("at")))
        gaps = F.transform(F.filter(each, lambda x: x["start"] >= x["at"]), lambda x: F.concat(cut(pieces, x["at"], x["start"]), F.lit(mark)))
        return F.concat(F.array_join(gaps, ""), cut(pieces, F.array_max(F.transform(spans, lambda x: x["end"])), F.lit(PIECE).cast("long") * F.size(pieces)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, F.element_at(F.transform(F.array(pieces), hidden), 1)).otherwise(text)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k, *_ in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
