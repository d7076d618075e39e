"""Substring deduplication: documents stream through suffix automata of shards of reference passages.

A window is ``WINDOW`` consecutive words.  A word is removed if a window that covers it also starts in a document
with a smaller doc_id.  The reference is the corpus itself, so shards of it must meet only the documents that can match:

1. Every window has a minimizer, the smallest hash among its runs of ``GRAM`` words.  Successive windows
   with the same minimizer are a zone, so a document has a zone for about every 18 words; zones alone are
   shuffled, as numbers.  A window can repeat only where its minimizer occurs in documents with different ids.
2. Zones with such minimizers are grouped by content.  Where a minimizer has several contents, the windows of each
   content, once each, find the first document that holds them.  So each repeated window of a document names
   one reference document, the smallest that holds it.
3. Stretches of text that repeat, and the stretches of reference documents that they name, go to shards of reference
   documents.  A shard's stretches become a suffix automaton over exact words, whose states know the
   smallest document that holds them.  The other documents' stretches stream through it: matching statistics
   of at least ``WINDOW`` words with a smaller document mark maximal spans, which are removed.

Hashes only propose what meets; the automaton compares words.  A shard is bounded by its share of the reference
words, never by a document count; a shard that many documents ask for (a passage in a third of all) is broadcast
to several tasks, among which its documents are dealt.  Texts are kept in a table bucketed by row, so that
the joins of what was found do not shuffle texts again.

Defined results: a null text has no words; texts of any length are read whole; a null doc_id counts as the largest number;
rows with the same doc_id are documents of their own whose windows do not repeat each other's; copies inside a
document stay; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import steps
from .shared import shared_path
from .simhash import runs_of

WINDOW, GRAM = 50, 16
#: Windows of a zone at most: longer runs of one minimizer (repeating texts) are parted.
ZONE = 64
#: Words of the reference in a shard, about; words of documents that one copy of a shard serves, about.
SHARD_WORDS, SERVED_WORDS = 100_000, 1_000_000
#: Words remembered with their hashes by a worker.
WORDS = 300_000
LAST = (1 << 63) - 1
_BASE = pow(0x9E3779B97F4A7C15, 3, 1 << 64)


class Hashes(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Powers:
    """Powers of an odd base and of its inverse, modulo 2^64."""

    def __init__(self):
        self.up = self.back = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
            self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * n, base))))
            self.back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * n, inverse))))
        return self.up[:n], self.back[:n]


def words(text: str | None) -> list[bytes]:
    """Words of a text: runs of anything but space, tab, LF, VT, FF and CR."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of runs of a document's words."""

    def __init__(self, found: list[bytes], hashes: Hashes, powers: Powers):
        own = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
        up, self.back = powers.to(len(found) + 1)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(own * up[:-1])))

    def runs(self, start: np.ndarray, length) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.back[start])


def zones(rolling: Rolling, n: int, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, hash of the content, first window and number of windows of each zone of ``n`` words."""
    grams = rolling.runs(np.arange(n - gram + 1), gram)
    low, span = grams, 1
    while 2 * span <= window - gram + 1:  # minima of runs of so many grams, by doubling
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    rest = window - gram + 1 - span
    low = np.minimum(low[: len(low) - rest], low[rest:])
    start, sizes = runs_of(low)
    pieces = -(-sizes // ZONE)
    first = np.repeat(start, pieces) + ZONE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    count = np.diff(np.concatenate((first, [len(low)])))
    return low[first], rolling.runs(first, count + window - 1), first, count


class Automaton:
    """Suffix automaton of word passages, each state with the smallest document that holds it."""

    def __init__(self):
        self.next, self.link, self.length, self.first, self.ids = [{}], [-1], [0], [LAST], {}

    def add(self, passage: list[bytes], doc: int) -> None:
        """Appends a passage after a separator of its own."""
        ids = self.ids
        last = self._append(getattr(self, "last", 0), -len(self.next), LAST) if len(self.next) > 1 else 0
        for word in passage:
            last = self._append(last, ids.setdefault(word, len(ids)), doc)
        self.last = last

    def _append(self, last: int, symbol: int, doc: int) -> int:
        follow, link, length, first = self.next, self.link, self.length, self.first
        new = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(doc)
        p = last
        while p >= 0 and symbol not in follow[p]:
            follow[p][symbol] = new
            p = link[p]
        if p < 0:
            return new
        q = follow[p][symbol]
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        copy = len(follow)
        follow.append(dict(follow[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        first.append(LAST)
        while p >= 0 and follow[p].get(symbol) == q:
            follow[p][symbol] = copy
            p = link[p]
        link[q] = link[new] = copy
        return new

    def close(self) -> None:
        """Hands the smallest documents up the links."""
        for v in np.argsort(-np.array(self.length), kind="stable").tolist():
            above = self.link[v]
            if above >= 0 and self.first[v] < self.first[above]:
                self.first[above] = self.first[v]

    def spans(self, passage: list[bytes], doc: int, window: int) -> list[tuple[int, int]]:
        """Maximal spans (start, end) of windows of ``passage`` that a document smaller than ``doc`` holds."""
        follow, link, length, first = self.next, self.link, self.length, self.first
        state, matched, out = 0, 0, []
        for i, word in enumerate(passage, 1):
            symbol = self.ids.get(word)
            if symbol is None:
                state, matched = 0, 0
                continue
            while symbol not in follow[state]:
                state = link[state]
                if state < 0:
                    break
                matched = length[state]
            if state < 0:
                state, matched = 0, 0
                continue
            state, matched = follow[state][symbol], matched + 1
            if matched >= window:
                matched = window  # the state of the window itself
                while length[link[state]] >= window:
                    state = link[state]
                if first[state] < doc:
                    if out and out[-1][1] >= i - window:
                        out[-1] = (out[-1][0], i)
                    else:
                        out.append((i - window, i))
        return out


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, end) joined where they meet or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def bucketed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` as (rid, doc, text), a table bucketed by rid, and its name; the caller drops it."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    path = shared_path(spark, "texts")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("doc_id").isNull().alias("unnamed"), F.col("text").cast("string").alias("text"))
    rows.repartition(n, "rid").write.bucketBy(n, "rid").option("path", path).saveAsTable(name)
    return spark.table(name), name


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` computed once and read back from a table in the shared folder: compressed columns, a fraction of a checkpoint's bytes."""
    path = shared_path(rows.sparkSession, "found")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _sized(batches, text: int):
    return chain.from_iterable(map(steps, batches, repeat(text)))


def _zones_of(window: int, gram: int):
    def run(batches):
        hashes, powers = Hashes(), Powers()
        for batch in _sized(batches, 2):
            out = [[] for _ in range(6)]
            for rid, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = words(text)
                if len(found) >= window:
                    own = zones(Rolling(found, hashes, powers), len(found), window, gram)
                    for k, column in enumerate((np.full(len(own[0]), rid), np.full(len(own[0]), doc), own[0].view(np.int64), own[1].view(np.int64), own[2].astype(np.int32), own[3].astype(np.int32))):
                        out[k].append(column)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["rid", "doc", "h", "z", "a", "n"])

    return run


def _windows_of(window: int):
    """(h, z, doc, w, j) of each window of the listed zones."""

    def run(batches):
        hashes, powers = Hashes(), Powers()
        for batch in _sized(batches, 1):
            out = [[] for _ in range(5)]
            for doc, text, listed in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rolling = Rolling(words(text), hashes, powers)
                for x in listed:
                    a, n = x["a"], x["n"]
                    values = rolling.runs(np.arange(a, a + n), window).view(np.int64)
                    for k, column in enumerate((np.full(n, x["h"]), np.full(n, x["z"]), np.full(n, doc), values, np.arange(n, dtype=np.int32))):
                        out[k].append(column)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["h", "z", "doc", "w", "j"])

    return run


def _routes(window: int):
    """(rid, doc, holder, a, b): words that repeat, with the document that holds them; holder is doc for the reference's own."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("rid", "doc", "holder", "a", "b")}
            for rid, doc, a, n, first, holds, given in zip(*(batch.column(k).to_pylist() for k in range(7))):
                holders = [first] * n
                for x in given or ():
                    holders[x["j"]] = x["holder"]
                s = 0
                for j in range(1, n + 1):
                    if j == n or holders[j] != holders[s]:
                        if holders[s] < doc or holds:
                            out["rid"].append(rid)
                            out["doc"].append(doc)
                            out["holder"].append(holders[s])
                            out["a"].append(a + s)
                            out["b"].append(a + j - 1 + window)
                        s = j
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[k], pa.int64()) for k in ("rid", "doc", "holder")] + [pa.array(out[k], pa.int32()) for k in ("a", "b")], ["rid", "doc", "holder", "a", "b"]
            )

    return run


def _passages(batches):
    """(holder, role, rid, doc, at, n, passage): role 0 for the reference's own words, 1 for those to look up."""
    for batch in _sized(batches, 2):
        out = {k: [] for k in ("holder", "role", "rid", "doc", "at", "n", "passage")}
        for rid, doc, text, routes in zip(*(batch.column(k).to_pylist() for k in range(4))):
            found, by = words(text), defaultdict(list)
            for x in routes:
                by[x["holder"]].append((x["a"], x["b"]))
            for holder, runs in by.items():
                for a, b in merged(runs):
                    for k, v in zip(out, (holder, int(holder != doc), rid, doc, a, b - a, b" ".join(found[a:b]))):
                        out[k].append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def _matched(window: int):
    """(rid, a, b) of what is removed; rows are sorted by shard and role, the reference's first."""

    def run(batches):
        at, automaton, building = None, Automaton(), True
        for batch in batches:
            out = {k: [] for k in ("rid", "a", "b")}
            for shard, copy, role, rid, doc, start, passage in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if at != (shard, copy):
                    at, automaton, building = (shard, copy), Automaton(), True
                if role == 0:
                    automaton.add(passage.split(b" "), doc)
                    continue
                if building:
                    automaton.close()
                    building = False
                for a, b in automaton.spans(passage.split(b" "), doc, window):
                    for k, v in zip(out, (rid, start + a, start + b)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["rid"], pa.int64()), pa.array(out["a"], pa.int32()), pa.array(out["b"], pa.int32())], ["rid", "a", "b"])

    return run


def removed_spans(base: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, served_words: int = SERVED_WORDS) -> DataFrame:
    """``base(rid, doc, text)`` -> (rid, spans): the maximal word spans [a, b) that go, sorted."""
    found = kept(base.select("rid", "doc", "text").mapInArrow(_zones_of(window, gram), "rid long, doc long, h long, z long, a int, n int"))
    contents = found.groupBy("h", "z").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    minimizers = contents.groupBy("h").agg(F.count("*").alias("contents"), F.min("first").alias("lo"), F.max("last").alias("hi")).where("lo < hi")
    shared = contents.join(minimizers.select("h", "contents"), "h").select("h", "z", "first", "contents")
    zoned = kept(found.join(shared, ["h", "z"]))

    # windows of minimizers with several contents, each content once, by its first document
    several = zoned.where("contents > 1 AND doc = first").dropDuplicates(["h", "z"])
    listed = several.groupBy("rid").agg(F.collect_list(F.struct("h", "z", "a", "n")).alias("listed"))
    windows = kept(base.join(listed, "rid").select("doc", "text", "listed").mapInArrow(_windows_of(window), "h long, z long, doc long, w long, j int"))
    holders = windows.groupBy(F.col("h").alias("wh"), F.col("w").alias("ww")).agg(F.min("doc").alias("holder"))
    earlier = windows.join(holders, (F.col("h") == F.col("wh")) & (F.col("w") == F.col("ww"))).where("holder < doc")
    given = earlier.groupBy(F.col("h").alias("gh"), F.col("z").alias("gz")).agg(F.collect_list(F.struct("j", "holder")).alias("given"))
    joined = zoned.join(given, (F.col("h") == F.col("gh")) & (F.col("z") == F.col("gz")), "left")
    holds = F.col("doc") == F.col("first")
    routes = joined.select("rid", "doc", "a", "n", "first", holds.alias("holds"), "given").mapInArrow(_routes(window), "rid long, doc long, holder long, a int, b int")
    asked = routes.groupBy("rid").agg(F.collect_list(F.struct("holder", "a", "b")).alias("routes"))
    pieces = kept(
        base.join(asked, "rid").select("rid", "doc", "text", "routes").mapInArrow(_passages, "holder long, role int, rid long, doc long, at int, n int, passage binary")
    )

    # shards of reference documents, and copies of those that many documents ask for
    total = pieces.where("role = 0").agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("holder"), F.lit(shards)))
    served = pieces.where("role = 1").groupBy("shard").agg(F.ceil(F.sum("n") / served_words).cast("int").alias("copies"))
    pieces = pieces.join(served, "shard")
    every = F.sequence(F.lit(0), F.col("copies") - 1)
    one = F.array(F.pmod(F.xxhash64("rid"), F.col("copies")).cast("int"))
    dealt = pieces.withColumn("copy", F.explode(F.when(F.col("role") == 0, every).otherwise(one)))
    dealt = dealt.select("shard", "copy", "role", "rid", "doc", "at", "passage").repartition("shard", "copy").sortWithinPartitions("shard", "copy", "role")
    spans = dealt.mapInArrow(_matched(window), "rid long, a int, b int")
    return spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def _rest(batches):
    """(doc_id, n_words, n_removed, kept): what is left of each document."""
    for batch in _sized(batches, 1):
        out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept")}
        for doc, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
            found = words(text)
            left, at = [], 0
            for a, b in merged([(x["a"], x["b"]) for x in spans or ()]):
                left += found[at:a]
                at = b
            left += found[at:]
            for k, v in zip(out, (doc, len(found), len(found) - len(left), b" ".join(left).decode("utf-8", "surrogatepass"))):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.int64()) for k in ("doc_id", "n_words", "n_removed")] + [pa.array(out["kept"], pa.string())], list(out))


def remaining(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, served_words: int = SERVED_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each document."""
    base, _ = bucketed(docs)
    spans = removed_spans(base, window, gram, shard_words, served_words)
    doc_id = F.when(~F.col("unnamed"), F.col("doc")).alias("doc_id")
    rows = base.join(kept(spans), "rid", "left").select(doc_id, "text", "spans")
    return rows.mapInArrow(_rest, "doc_id long, n_words long, n_removed long, kept string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""
    return remaining(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {last}) AS doc, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT rid, doc, i, md5(array_to_string(w[i:i + {window} - 1], ' ')) AS k
  FROM (SELECT rid, doc, w, unnest(range(1, len(w) - {window} + 2)) AS i FROM d)),
first AS (SELECT k, min(doc) AS m FROM win GROUP BY k),
gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + {window})) AS p FROM win JOIN first USING (k) WHERE m < doc),
word AS (SELECT rid, w[p] AS word, p FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (
  SELECT word.rid, string_agg(word, ' ' ORDER BY word.p) AS kept, count(*) AS n
  FROM word LEFT JOIN gone ON gone.rid = word.rid AND gone.p = word.p WHERE gone.p IS NULL GROUP BY word.rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.rid = d.rid
""".format(window=WINDOW, last=LAST)
