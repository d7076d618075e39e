"""Many phrases in one pass over texts: terms, aliases, triggers and section markers.

A lexicon's phrases, of one word or several, become one Aho-Corasick automaton over a text's words, so the time for a text does
not depend on how many phrases there are.  Phrases match whole words (runs of letters and digits), whatever their case and
whatever stands between the words; of overlapping matches the leftmost counts, of those the longest.  Every match gives a
row for each term that its phrase stands for, with its place in the text as it is written.

Terms may be gated: they count only where another phrase, a trigger of their group, stands elsewhere in the same text.
Markers part a text into sections; a match belongs to the section of the last marker before it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Lexicon:
    """``terms``: phrase -> the terms it stands for; ``gates``: term -> its group; ``triggers``: group -> phrases that
    open it; ``markers``: phrase -> the section that begins after it."""

    terms: dict[str, tuple[str, ...]]
    gates: dict[str, str] = field(default_factory=dict)
    triggers: dict[str, tuple[str, ...]] = field(default_factory=dict)
    markers: dict[str, str] = field(default_factory=dict)
    first_section: str = "other"


def _folded(text: str) -> str:
    return "".join(f" {w.lower()} " for w in _WORD.findall(text))


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        known: dict[str, dict] = {}
        for kind, phrases in (("terms", lexicon.terms), ("markers", lexicon.markers)):
            for phrase, meaning in phrases.items():
                known.setdefault(_folded(phrase), {})[kind] = meaning
        for group, phrases in lexicon.triggers.items():
            for phrase in phrases:
                known.setdefault(_folded(phrase), {}).setdefault("groups", set()).add(group)
        known.pop("", None)
        self.automaton = ahocorasick.Automaton()
        for phrase, meaning in known.items():
            self.automaton.add_word(phrase, (len(phrase), meaning))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, dict]]:
        """(start, end, meaning) of the leftmost-longest matches that share no word, and what phrases inside them mean as triggers."""
        words = list(_WORD.finditer(text))
        if not words or not len(self.automaton):
            return []
        starts, at = [], 0
        pieces = []
        for w in words:
            piece = f" {w[0].lower()} "
            starts.append(at)
            at += len(piece)
            pieces.append(piece)
        found = sorted(((end - size + 1, -size, meaning) for end, (size, meaning) in self.automaton.iter("".join(pieces))), key=lambda m: m[:2])
        out, last = [], 0
        for start, size, meaning in found:
            if start >= last:
                first = bisect_right(starts, start) - 1
                final = bisect_right(starts, start - size - 1) - 1
                out.append((words[first].start(), words[final].end(), meaning))
                last = start - size
        return out

    def rows(self, text: str) -> list[tuple[str, str, int, int, str]]:
        """(term, phrase, start, end, section) of a text."""
        found = self.matches(text)
        opened: dict[str, list[int]] = {}
        for k, (_, _, meaning) in enumerate(found):
            for group in meaning.get("groups", ()):
                opened.setdefault(group, []).append(k)
        section, out = self.lexicon.first_section, []
        for k, (start, end, meaning) in enumerate(found):
            for term in dict.fromkeys(meaning.get("terms", ())):
                group = self.lexicon.gates.get(term)
                if group is None or any(other != k for other in opened.get(group, ())):
                    out.append((term, " ".join(_WORD.findall(text[start:end])).lower(), start, end, section))
            section = meaning.get("markers", section)
        return out


def find(rows: DataFrame, key: str, text: str, lexicon: Lexicon) -> DataFrame:
    """(key, term, phrase, start, end, section): every match in ``text``, a row for each of its terms.

    ``start`` and ``end`` (exclusive) count code points.  A null text has no matches.  The lexicon goes to
    the workers with the function; it must fit a worker's memory.
    """
    kind = dict(rows.dtypes)[key]
    names = ["term", "phrase", "start", "end", "section"]

    def run(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            keys, out = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    found = matcher.rows(t)
                    keys += [i] * len(found)
                    out += found
            columns = [pa.array([r[k] for r in out], pa.int32() if 2 <= k <= 3 else pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int32())), *columns], [key, *names])

    return rows.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, term string, phrase string, start int, end int, section string")


def routed(found: DataFrame, key: str, sections: list[str]) -> DataFrame:
    """One row a key that has matches: ``terms`` and, for each of ``sections``, the sorted terms that are in it and in none before it."""
    order = F.array_position(F.array(*map(F.lit, sections)), F.col("section"))
    best = found.groupBy(key, "term").agg(F.min(F.when(order > 0, order)).alias("_at"))
    lists = [F.array_sort(F.collect_list(F.when(F.col("_at") == k, F.col("term")))).alias(s) for k, s in enumerate(sections, 1)]
    return best.groupBy(key).agg(F.array_sort(F.collect_list("term")).alias("terms"), *lists)


def flags(x: Column, cases: list[tuple[str, str, int | None]]) -> Column:
    """array of struct(name, value): the cases (name, pattern, group) that ``x`` has, in their order, with the number that
    the pattern's group captures first; without a group, or where it is no number, the value is null."""
    found = []
    for name, pattern, group in cases:
        value = F.regexp_extract(x, pattern, group).try_cast("bigint") if group is not None else F.lit(None).cast("bigint")
        found.append(F.when(x.rlike(pattern), F.struct(F.lit(name).alias("name"), value.alias("value"))))
    return F.filter(F.array(*found), lambda f: f.isNotNull())
