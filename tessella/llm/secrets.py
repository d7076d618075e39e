"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Base spans are the matches of three patterns.  Beyond them, all tokens of 20 or more characters of
encoded data are candidates.  For each its encoding is inferred from the characters it has, and three
tests ask whether its symbols look like independent uniform draws from that alphabet: chi-squared on the
symbol counts, the runs above and below the alphabet's middle, and the correlation of neighbours.  A
candidate that any of them rejects (Bonferroni over the three) is no secret.

Passing says little about a short token, so the battery's chi-squared statistic gets a second p-value:
the chance that draws from ``text``'s symbols are as even.  Chi-squared depends on the number of equal
pairs of symbols alone, whose distribution is computed exactly up to ``EXACT`` symbols, for uniform
draws and for text, by multiplying the symbols' generating functions; longer tokens are judged by the
moments, with a bound on the tail.  Candidates are put into strata by length; in each the
Benjamini-Hochberg rule on the p-values of text bounds the share of false discoveries, with rejected
candidates counted as tested.  P-values are counted in bins of a twentieth of a decade, over all documents.

Offsets are code points, ends exclusive.  A pattern's matches and the pieces between them alternate, so
running sums of their lengths give every offset.  Only DataFrame functions are used.

Defined results: null and empty texts have no spans; very long texts take time in proportion to their
matches (running sums and maxima go block by block); documents are judged row by row, whatever their
doc_id, so that repeated rows and ties are judged alike; added spans never overlap base ones; the lists are
empty strings where there is nothing; other columns are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: The contract's patterns (fixed values): kind, pattern, least length of the match, least length of group 2.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, 6),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
]
ADDED = "random"
#: Matches that fail the least length are left out of the pattern where that can't change the others.
_SCAN = {"assign": BASE[0][1], "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from narrow to wide: characters, alphabet, and the parts of text in it (symbols, share).  By these shares
#: two symbols of an identifier are equal with a chance of 0.044; in identifiers made of words it is 0.050 to 0.053.
ENCODINGS = [
    ("^[0-9]+$", _DIGITS, [(_DIGITS, 1)]),
    ("^[0-9a-f]+$", _DIGITS + "abcdef", [(_DIGITS, 0.7), ("abcdef", 0.3)]),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF", [(_DIGITS, 0.7), ("ABCDEF", 0.3)]),
    ("^[a-z]+$", _LOWER, [(_LOWER, 1)]),
    ("^[A-Z]+$", _UPPER, [(_UPPER, 1)]),
    ("^[A-Z2-7]+$", _UPPER + "234567", [(_UPPER, 0.9), ("234567", 0.1)]),
    ("^[A-Za-z]+$", _UPPER + _LOWER, [(_UPPER, 0.15), (_LOWER, 0.85)]),
    ("^[0-9a-z]+$", _DIGITS + _LOWER, [(_DIGITS, 0.15), (_LOWER, 0.85)]),
    ("^[0-9A-Z]+$", _DIGITS + _UPPER, [(_DIGITS, 0.15), (_UPPER, 0.85)]),
    ("^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS, [(_UPPER, 0.1), (_LOWER, 0.8), (_DIGITS, 0.1)]),
    ("", _UPPER + _LOWER + _DIGITS + "+/_-", [(_UPPER, 0.08), (_LOWER, 0.8), (_DIGITS, 0.05), ("+/_-", 0.07)]),
]
#: How much rarer each symbol of a part is in text than the one before it: two letters are then as often equal as in English.
FADE = 0.885
#: Symbols up to which distributions are exact; parts of a running sum that are summed at a time.
LEAST, EXACT, BLOCK = 20, 64, 64
#: A uniformity test's level, the rate of false discoveries, the strata's least lengths, bins a decade, the last bin.
LEVEL, RATE, STRATA, BINS, LAST = 0.001, 0.01, (20, 24, 32, 40, 64, 128), 20, 400
_SPAN = "array<struct<start:long,k:int,end:long>>"


def _let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once, though ``f`` uses it often."""
    return F.transform(F.array(x), f)[0]


def _scan(values: Column, plus) -> Column:
    """Running ``plus`` over an array of longs that are not negative, block by block: appending to long arrays would be quadratic."""
    def run(items: Column, start: Column) -> Column:
        grow = lambda out, x: F.concat(out, F.array(plus(F.element_at(out, -1), x)))
        return F.aggregate(items, F.array(start), grow)  # the start comes first

    zero, size = F.lit(0).cast("long"), F.size(values)
    blocks = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    local = F.transform(blocks, lambda k: run(F.slice(values, k * BLOCK + 1, BLOCK), zero))

    def joined(parts: Column) -> Column:
        starts = run(F.transform(parts, lambda p: F.element_at(p, -1)), zero)
        shifted = lambda p, start: F.transform(F.slice(p, 2, BLOCK), lambda x: plus(x, start))
        return F.flatten(_let(starts, lambda given: F.zip_with(parts, F.slice(given, 1, F.size(parts)), shifted)))

    return _let(local, joined)


def _spans(text: Column, pattern: str, kind: int, least: int = 0, least_group: int = 0, keep_text: bool = False) -> Column:
    """Spans of the matches of ``pattern`` in ``text``, in order; failing ones are dropped."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least_group else F.array().cast("array<string>")
    kind_of = _SPAN.replace("end:long", "end:long,text:string") if keep_text else _SPAN

    def placed(x: Column) -> Column:
        both = F.zip_with(F.slice(x["gaps"], 1, F.size(x["all"])), x["all"], lambda g, m: (F.length(g) + F.length(m)).cast("long"))

        def span(m: Column, k: Column, ends: Column) -> Column:
            end = F.get(ends, k)
            fields = [(end - F.length(m)).alias("start"), F.lit(kind).alias("k"), end.alias("end")] + ([m.alias("text")] if keep_text else [])
            good = F.length(m) >= least
            if least_group:
                good = good & (F.length(F.get(x["second"], k)) >= least_group)
            return F.when(good, F.struct(*fields))

        def all_spans(ends: Column) -> Column:
            return F.filter(F.transform(x["all"], lambda m, k: span(m, k, ends)), lambda s: s.isNotNull())

        return _let(_scan(both, lambda a, b: a + b), all_spans)

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("all"), second.alias("second"))
    return F.when(text.rlike(pattern), _let(parts, placed)).otherwise(F.array().cast(kind_of))


def _free(tokens: Column, base: Column) -> Column:
    """The tokens that no base span overlaps.

    A token is free if, of all spans that start before its end, the furthest end isn't behind its start; both
    are sorted and a running maximum over the spans, ordered by start among the tokens' ends, tells.
    """
    event = lambda at, is_token, end, k: F.struct(at.alias("at"), is_token.alias("is_token"), end.alias("end"), k.alias("i"))
    of_base = F.transform(base, lambda b: event(b["start"], F.lit(1), b["end"], F.lit(-1)))
    of_tokens = F.transform(tokens, lambda t, i: event(t["end"], F.lit(0), F.lit(0).cast("long"), i))
    events = F.array_sort(F.concat(of_base, of_tokens))  # at equal places a token's end comes before a start

    def reached(e: Column) -> Column:
        far = _scan(F.transform(e, lambda x: x["end"]), F.greatest)
        pairs = F.zip_with(e, far, lambda x, m: F.struct(x["i"].alias("i"), m.alias("far")))
        own = F.array_sort(F.filter(pairs, lambda p: p["i"] >= 0))
        return _let(own, lambda reach: F.filter(tokens, lambda t, i: F.get(reach, i)["far"] <= t["start"]))

    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), _let(events, reached)).otherwise(tokens)


# --- distributions of equal pairs ------------------------------------------------------------------


def text_shares(parts: list[tuple[str, float]], fade: float = FADE) -> np.ndarray:
    """Each symbol's share in text."""
    out = []
    for symbols, share in parts:
        each = fade ** np.arange(len(symbols))
        out.append(share * each / each.sum())
    return np.concatenate(out)


def pair_chances(shares: np.ndarray, most: int = EXACT) -> np.ndarray:
    """[n, k]: the chance that ``n`` draws with these shares have ``k`` equal pairs, exactly."""
    top = most * (most - 1) // 2
    ways = np.zeros((most + 1, top + 1))
    ways[0, 0] = 1.0  # divided by n!, and by each symbol's factorials
    for p in shares:
        new, term = ways.copy(), 1.0
        for c in range(1, most + 1):
            term *= p / c
            pairs = c * (c - 1) // 2
            if term < 1e-60:
                break
            new[c:, pairs:] += term * ways[: most + 1 - c, : top + 1 - pairs]
        ways = new
    return ways * np.array([float(math.factorial(n)) for n in range(most + 1)])[:, None]


def _moments(shares: np.ndarray) -> tuple[float, float]:
    """Sums of squares and cubes of the shares, which give the mean and the variance of the equal pairs."""
    return float((shares**2).sum()), float((shares**3).sum())


def _tables() -> dict[str, list]:
    """By encoding: the most pairs that uniform draws have at LEVEL / 3, and bins of text's lower tail, by length."""
    first, bins, limits, at = [], [], [], 0
    for _, alphabet, parts in ENCODINGS:
        uniform, text = pair_chances(np.full(len(alphabet), 1 / len(alphabet))), pair_chances(text_shares(parts))
        for n in range(LEAST, EXACT + 1):
            above = 1 - np.cumsum(uniform[n])
            limits.append(int(np.argmax(above <= LEVEL / 3)))
            below = np.cumsum(text[n])
            own = np.minimum(LAST, np.floor(-BINS * np.log10(np.maximum(below[below < 0.5], 1e-300)))).astype(int).tolist()
            first.append(at)
            bins += [*own, 0]
            at += len(own) + 1
    return {"first": first, "bins": bins, "limits": limits}


@lru_cache(maxsize=1)
def _looked_up() -> dict[str, str]:
    return {k: ",".join(map(str, v)) for k, v in _tables().items()}


def _table(name: str) -> Column:
    """A table as a constant array."""
    return F.split(F.lit(_looked_up()[name]), ",").cast("array<int>")


def _by_encoding(token: Column, values: list) -> Column:
    out = F.lit(values[-1])
    for (chars, _, _), value in reversed(list(zip(ENCODINGS[:-1], values))):
        out = F.when(token.rlike(chars), F.lit(value)).otherwise(out)
    return out


def battery(token: Column) -> Column:
    """struct(uniform, bin, n): whether the tests let uniform draws pass, the bin of text's p-value, the symbols counted."""
    rows = EXACT - LEAST + 1

    def run(x: Column) -> Column:
        n, a = x["n"].cast("double"), F.length(x["alphabet"]).cast("double")
        counts = F.transform(F.split(x["alphabet"], ""), lambda c: (x["n"] - F.length(F.replace(x["t"], c, F.lit("")))).cast("long"))
        pairs = F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + F.floor(c * (c - 1) / 2))

        def judged(k: Column) -> Column:
            at = x["e"] * rows + x["n"] - LEAST
            exact = x["n"] <= EXACT
            drawn = n * (n - 1) / 2
            even = drawn / a + CRITICAL * F.sqrt(drawn / a * (1 - 1 / a))
            squares, cubes = _by_encoding(x["t"], [_moments(text_shares(e[2]))[0] for e in ENCODINGS]), _by_encoding(x["t"], [_moments(text_shares(e[2]))[1] for e in ENCODINGS])
            mean = drawn * squares
            spread = drawn * (squares - squares * squares) + n * (n - 1) * (n - 2) * (cubes - squares * squares)
            z = F.greatest(F.lit(0.0), mean - k) / F.sqrt(spread)
            far = F.least(F.lit(LAST), F.floor(BINS * (z * z / 2 / math.log(10) + math.log10(2)) * (z > 0).cast("int"))).cast("int")
            tail = F.get(_table("first"), F.when(exact, at).otherwise(0).cast("int"))
            size = F.coalesce(F.get(_table("first"), F.when(exact, at + 1).otherwise(1).cast("int")), F.lit(len(_tables_bins()))) - tail
            near = F.when(k < size, F.get(_table("bins"), (tail + k).cast("int"))).otherwise(0)
            chi = F.when(exact, k <= F.get(_table("limits"), F.when(exact, at).otherwise(0).cast("int"))).otherwise(k <= even)
            codes = F.filter(F.transform(F.split(x["t"], ""), lambda c: (F.instr(x["alphabet"], c) - 1).cast("double")), lambda c: c >= 0)
            return F.struct((chi & _let(codes, lambda v: _order_passes(v, n, a))).alias("uniform"), F.when(exact, near).otherwise(far).alias("bin"), x["n"].alias("n"))

        return _let(pairs, judged)

    symbols = F.regexp_replace(token, "=+$", "")
    bound = _let(
        symbols,
        lambda t: F.struct(t.alias("t"), F.length(t).alias("n"), _by_encoding(t, [e[1] for e in ENCODINGS]).alias("alphabet"), _by_encoding(t, list(range(len(ENCODINGS)))).alias("e")),
    )
    return _let(bound, run)


#: |z| that uniform draws exceed with a chance of LEVEL / 3.
CRITICAL = NormalDist().inv_cdf(1 - LEVEL / 6)


def _tables_bins() -> list[str]:
    return _looked_up()["bins"].split(",")


def _order_passes(v: Column, n: Column, a: Column) -> Column:
    """Whether the runs around the alphabet's middle and the correlation of neighbours are as in uniform draws."""
    middle = (a - 1) / 2
    high = F.size(F.filter(v, lambda x: x > middle)).cast("double")
    low = n - high
    nexts = F.slice(v, 2, F.size(v))
    ahead = F.slice(v, 1, F.size(v) - 1)
    changes = F.aggregate(F.zip_with(ahead, nexts, lambda p, q: ((p > middle) != (q > middle)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    both = 2 * high * low
    spread = F.sqrt(F.greatest(F.lit(1e-9), both * (both - n) / (n * n * (n - 1))))
    runs = (high > 0) & (low > 0) & (F.abs((changes - both / n) / spread) <= CRITICAL)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    along = F.aggregate(F.zip_with(ahead, nexts, lambda p, q: (p - mean) * (q - mean)), F.lit(0.0), lambda s, x: s + x)
    return runs & (total > 0) & (F.abs((along / total + 1 / n) * F.sqrt(n)) <= CRITICAL)


def _stratum(n: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(STRATA[1:], 1):
        out = F.when(n >= least, k).otherwise(out)
    return out


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of spans), tests (array of candidates with stratum and p-value bin)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = F.concat(*[_spans(F.col("text"), _SCAN[kind], k, least, group) for k, (kind, _, least, group) in enumerate(BASE, 1)])
    rows = rows.select("doc_id", F.array_sort(base).alias("base"), _spans(F.col("text"), TOKEN, len(BASE) + 1, keep_text=True).alias("tokens"))
    fresh = _free(F.col("tokens"), F.col("base"))
    tested = F.transform(fresh, lambda t: F.struct(t["start"].alias("start"), t["k"].alias("k"), t["end"].alias("end"), battery(t["text"]).alias("p")))
    kept = F.transform(
        tested,
        lambda t: F.struct(
            t["start"].alias("start"), t["k"].alias("k"), t["end"].alias("end"),
            t["p"]["uniform"].alias("uniform"), _stratum(t["p"]["n"]).alias("stratum"), t["p"]["bin"].alias("bin"),
        ),
    )
    return rows.select("doc_id", "base", kept.alias("tests"))


def thresholds(found: DataFrame, rate: float = RATE) -> dict[int, int]:
    """The least p-value bin that the Benjamini-Hochberg rule accepts, by stratum of length.

    A candidate that the uniformity tests reject is counted as tested and accepts nothing.
    """
    bins = found.select(F.explode("tests").alias("t")).select("t.stratum", F.when(F.col("t.uniform"), F.col("t.bin")).otherwise(-1).alias("bin"))
    bins = bins.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    sums = bins.select("stratum", "bin", F.sum("n").over(down).alias("accepted"), F.sum("n").over(Window.partitionBy("stratum")).alias("all"))
    good = sums.where((F.col("bin") >= 0) & (F.pow(F.lit(10.0), -F.col("bin") / BINS) * F.col("all") <= rate * F.col("accepted")))
    # one row a stratum
    return {r["stratum"]: r["least"] for r in good.groupBy("stratum").agg(F.min("bin").alias("least")).collect()}


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind, *_ in BASE], F.lit(ADDED))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["k"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda b: b["k"] == kind)).cast("long")


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every document."""
    found = cut(found_spans(docs))
    least = thresholds(found, rate)
    floors = F.array(*[F.lit(least.get(k, 1_000)) for k in range(len(STRATA))])
    added = F.filter("tests", lambda t: t["uniform"] & (t["bin"] >= F.element_at(floors, t["stratum"] + 1)))
    added = F.transform(added, lambda t: F.struct(t["start"].alias("start"), t["k"].alias("k"), t["end"].alias("end")))
    rows = found.select("doc_id", "base", added.alias("added"))
    counts = [_count(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE, 1)]
    return rows.select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_random"),
    )
