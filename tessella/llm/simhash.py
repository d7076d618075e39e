"""SimHash near-deduplication over a segment-popcount embedding.

A text's fingerprint has a bit set where more than half of its shingles' XXH64 hashes have it set.
Fingerprints link at a Hamming distance of ``max_bits`` or less.  Each fingerprint maps to the vector
of bit counts of its 2-bit segments; the Manhattan distance of two such vectors never exceeds their
Hamming distance.  The segments are dealt into ``groups`` groups.  Vectors at Manhattan distance at
most ``max_bits`` agree on at least ``groups - max_bits`` whole groups, so the grid join takes as
cells every choice of that many groups: linked fingerprints meet in at least one cell.  In a cell the
Manhattan bound filters, the Hamming distance decides.  A cell returns a spanning forest of its links,
never all its pairs: small cells by shifted comparison, large ones by a search whose unvisited rest
shrinks.  Components are then joined over all cells, and over distinct fingerprints only, so exact
copies cost one fingerprint.

Defined results: null and empty texts have fingerprint 0, linked like any other; very long texts are read whole,
their shingles hashed in blocks; repeated rows share a fingerprint and each has a row of the result; fewer words
than a shingle: the whole sequence is hashed; an exact tie of a bit leaves it 0; a null ``doc_id`` never
names a component unless all its members are null; other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import steps
from .components import components
from .shared import columns, cut

SHINGLE, SEED, MAX_BITS, GROUPS = 4, 42, 4, 7
#: Shingles hashed at a time; bounds memory on very long texts.
BLOCK = 1 << 16
#: Cells above this many members are searched, smaller ones compared by shifts.
SMALL_CELL = 16
_EVEN = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        pieces = [joined[p:q] for p, q in zip(first[at : at + BLOCK], last[at : at + BLOCK])]
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, len(pieces))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(first), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches):
        for part in chain.from_iterable(map(steps, batches, repeat(1))):
            fps = np.array([fingerprint(t, shingle, seed) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of 2-bit segments in unary code (0, 1, 2 as 00, 01, 11).

    The Hamming distance of two such codes is the Manhattan distance of the bit-count vectors.
    """
    high = fp >> np.uint64(1)
    return ((fp | high) & np.uint64(_EVEN)) | (((fp & high) & np.uint64(_EVEN)) << np.uint64(1))


def cell_masks(max_bits: int = MAX_BITS, groups: int = GROUPS) -> np.ndarray:
    """A mask over the unary code for each choice of ``groups - max_bits`` groups of segments."""
    if not max_bits < groups <= 32:
        raise ValueError("groups must be above max_bits and at most 32")
    parts = [sum(3 << (2 * int(s)) for s in part) for part in np.array_split(np.arange(32), groups)]
    return np.array([sum(c) for c in combinations(parts, groups - max_bits)], np.uint64)


def _links(cells: np.ndarray, fps: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Index pairs that span the links inside each run of equal ``cells`` (whole runs, sorted)."""
    code, out = embed(fps), []
    start = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    sizes = np.diff(np.concatenate((start, [len(cells)])))
    big = np.repeat(sizes > SMALL_CELL, sizes)
    for d in range(1, min(SMALL_CELL, int(sizes.max(initial=1)))):
        i = np.flatnonzero((cells[:-d] == cells[d:]) & ~big[:-d])
        if not len(i):
            break
        i = i[np.bitwise_count(code[i] ^ code[i + d]) <= max_bits]
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= max_bits]
        out.append(np.stack([i, i + d]))
    for s, n in zip(start[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist()):
        rest, frontier = np.arange(s, s + n), []
        while len(rest):
            if frontier:
                at = frontier.pop()
            else:
                at, rest = int(rest[0]), rest[1:]
            near = np.bitwise_count(code[rest] ^ code[at]) <= max_bits
            near &= np.bitwise_count(fps[rest] ^ fps[at]) <= max_bits
            found = rest[near]
            if len(found):
                out.append(np.stack([np.full(len(found), at), found]))
                frontier.extend(found.tolist())
                rest = rest[~near]
    return out


def link_edges(distinct: DataFrame, max_bits: int = MAX_BITS, groups: int = GROUPS) -> DataFrame:
    """``distinct(family, fp)`` -> edges (family, a, b) that join the same fingerprints as all links do.

    Fingerprints of different families never meet.
    """
    masks = cell_masks(max_bits, groups)
    schema = pa.schema([("family", pa.int16()), ("a", pa.int64()), ("b", pa.int64())])

    def deal(batches):
        for batch in batches:
            fp = batch.column(1).to_numpy().view(np.uint64)
            code, family = embed(fp), batch.column(0).to_numpy().astype(np.int16)
            for k, mask in enumerate(masks):
                grid = pa.array(family * np.int16(len(masks)) + np.int16(k))
                yield pa.RecordBatch.from_arrays([grid, pa.array((code & mask).view(np.int64)), batch.column(1)], ["grid", "cell", "fp"])

    def spanned(grid, cell, fp):
        """Edges of whole cells, sorted."""
        if len(fp) > 1:
            new = (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1])
            pairs = _links(np.concatenate(([0], np.cumsum(new))), fp, max_bits)
            if pairs:
                i, j = np.concatenate(pairs, axis=1)
                ends = fp.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(grid[i] // np.int16(len(masks))), pa.array(ends[i]), pa.array(ends[j])], schema=schema)

    def search(batches):
        waiting = []  # the last cell so far, in parts
        for batch in batches:
            if not batch.num_rows:
                continue
            grid, cell, fp = (batch.column(k).to_numpy() for k in range(3))
            fp = fp.view(np.uint64)
            other = np.flatnonzero((grid != grid[-1]) | (cell != cell[-1]))
            if waiting and not len(other) and (waiting[-1][0][-1], waiting[-1][1][-1]) == (grid[-1], cell[-1]):
                waiting.append((grid, cell, fp))
                continue
            tail = int(other[-1]) + 1 if len(other) else 0
            parts = waiting + [(grid[:tail], cell[:tail], fp[:tail])]
            yield from spanned(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
            waiting = [(grid[tail:], cell[tail:], fp[tail:])]
        if waiting:
            yield from spanned(*(np.concatenate([p[k] for p in waiting]) for k in range(3)))

    cells = distinct.select(F.col("family").cast("short").alias("family"), "fp").mapInArrow(deal, "grid short, cell long, fp long")
    cells = cells.repartition("grid", "cell").sortWithinPartitions("grid", "cell", "fp")
    return cells.mapInArrow(search, "family short, a long, b long").distinct()


def near_groups(docs: DataFrame, max_bits: int = MAX_BITS, groups: int = GROUPS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that links reach)."""
    base = cut(fingerprints(docs, shingle))
    by_fp = base.groupBy("fp").agg(F.min("doc_id").alias("_first"))
    links = link_edges(by_fp.select(F.lit(0).alias("family"), "fp"), max_bits, groups)
    roots = components(links.select("a", "b"))
    named = by_fp.join(roots, by_fp["fp"] == roots["node"], "left").select(
        "fp", "_first", F.coalesce("root", "fp").alias("root")
    )
    ids = named.groupBy("root").agg(F.min("_first").alias("component_id"))
    return base.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# --- near copies by the similarity of five-word shingles -----------------------------------------

#: One document in so many is counted to find frequent shingles, which are looked at last; at most so many are kept.
SAMPLE, FREQUENT = 16, 100_000
#: Buckets up to this size may become pairs, if those are at most PAIRS a member; others are searched with their sets.
PAIRED, PAIRS = 1024, 32
#: Bits of the map of candidates; documents outside it need no sets for verification.
MAP_BITS = 1 << 25
#: Pairs that are verified in one task, about.
TASK_PAIRS = 2048
#: Shingles of a block; larger buckets are searched by each two of their blocks.
BLOCK_SHINGLES = 1 << 21
_POSTING = "key int, doc_id long, n int, at int"


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a text's distinct shingles (32 bits, sorted); fewer words make one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    runs = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = np.unique(np.fromiter(map(xxhash.xxh32_intdigest, runs), np.uint32, len(runs)))
    return h.view(np.int32)


def prefix(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set, rare ones first: two sets whose similarity is ``least`` share one of them."""
    n = len(found)
    if len(frequent):
        at = np.searchsorted(frequent, found).clip(max=len(frequent) - 1)
        place = np.where(frequent[at] == found, counts[at], 0)
        found = found[np.lexsort((found, place))]
    return found[: n - int(np.ceil(least * n - 1e-9)) + 1]


def may_pass(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles whose first common one is at ``at`` and ``to`` can be similar."""
    return np.minimum(n - at, m - to) >= least / (1 + least) * (n + m) - 1e-9


def whole_runs(batches, keys: int):
    """Tables of the sorted batches, none of which parts rows that are equal in their first ``keys`` columns."""
    waiting, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy() for k in range(keys)]
        other = np.flatnonzero(np.any([v != v[-1] for v in values], axis=0))
        tail = int(other[-1]) + 1 if len(other) else 0
        if waiting and not tail and last == [v[-1] for v in values]:
            waiting.append(batch)
            continue
        if waiting or tail:
            yield pa.Table.from_batches([*waiting, batch.slice(0, tail)])
        waiting, last = [batch.slice(tail)], [v[-1] for v in values]
    if waiting:
        yield pa.Table.from_batches(waiting)


def runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    start = np.flatnonzero(np.concatenate(([True], new)))
    return start, np.diff(np.concatenate((start, [len(keys[0])])))


def spanning(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Index pairs that span all the pairs of similar sets."""
    size = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sets, mark = np.split(flat, np.cumsum(size)[:-1]), np.zeros(int(flat.max()) + 1, bool)
    rest, frontier, out, kept = np.arange(len(sets)), [], [], None
    while len(rest):
        if frontier:
            at = frontier.pop()
        else:
            at, rest = int(rest[0]), rest[1:]
        if kept is None or len(rest) < 0.5 * len(kept):
            kept = rest
            flat = np.concatenate([sets[k] for k in kept]) if len(kept) else flat[:0]
            starts = np.concatenate(([0], np.cumsum(size[kept])[:-1]))
        if not len(rest):
            break
        mark[sets[at]] = True
        both = np.add.reduceat(mark[flat], starts, dtype=np.int64)[np.searchsorted(kept, rest)]
        mark[sets[at]] = False
        near = both >= least * (size[rest] + size[at] - both)
        found = rest[near].tolist()
        out += [(at, k) for k in found]
        frontier += found
        rest = rest[~near]
    return out


def near_copy_edges(docs: DataFrame, least: float, shingle: int, joined: DataFrame | None = None) -> DataFrame:
    """(a, b) of doc_ids that join the same documents as all pairs do that share ``least`` of their shingles.

    ``joined(node, root)`` names groups that are joined already: pairs inside of one are not verified.

    Each set is posted under its ``prefix``, in which similar sets meet.  A bucket of equal shingles becomes
    the pairs that lengths and places allow; where those are many, it is searched with its members' sets.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def all_shingles(batches):
        for part in chain.from_iterable(map(steps, batches, repeat(1))):
            for text in part.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, shingle))], ["key"])

    sample = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(all_shingles, "key int")
    often = sample.groupBy("key").agg(F.count("*").alias("n")).where("n > 3").orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow().sort_by("key")
    frequent, counts = often["key"].to_numpy(), often["n"].to_numpy()

    def post(batches):
        for batch in chain.from_iterable(map(steps, batches, repeat(1))):
            waiting, total = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shingle_set(text, shingle)
                first = prefix(found, frequent, counts, least)
                waiting.append((first, doc_id, len(found)))
                total += len(first)
                if total >= 1 << 17:
                    yield posted(waiting)
                    waiting, total = [], 0
            if waiting:
                yield posted(waiting)

    def posted(waiting):
        sizes = [len(first) for first, *_ in waiting]
        columns = [
            np.concatenate([first for first, *_ in waiting]),
            np.repeat(np.array([doc_id for _, doc_id, _ in waiting], np.int64), sizes),
            np.repeat(np.array([n for *_, n in waiting], np.int32), sizes),
            np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]),
        ]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["key", "doc_id", "n", "at"])

    def meet(batches):
        """Pairs (a, b) of small buckets; of others the members (a, key, block i, block j)."""
        for table in whole_runs(batches, 1):
            key, doc, n, at = (table.column(k).to_numpy() for k in range(4))
            start, sizes = runs_of(key)
            small = np.repeat((sizes > 1) & (sizes <= SMALL_CELL), sizes)
            for d in range(1, min(SMALL_CELL, int(sizes.max()))):
                i = np.flatnonzero((key[:-d] == key[d:]) & small[:-d])
                i = i[may_pass(n[i], at[i], n[i + d], at[i + d], least) & (doc[i] != doc[i + d])]
                yield pairs_of(doc[i], doc[i + d])
            for s, m in zip(start[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist()):
                own = np.arange(s, s + m)
                if m <= PAIRED:
                    k, p, x = n[own], at[own], doc[own]
                    i, j = np.nonzero(np.triu(may_pass(k[:, None], p[:, None], k, p, least) & (x[:, None] != x), 1))
                    if len(i) <= PAIRS * m:
                        yield pairs_of(x[i], x[j])
                        continue
                    own = own[np.union1d(i, j)]
                    m = len(own)
                blocks = 1 + int(n[own].sum(dtype=np.int64)) // BLOCK_SHINGLES
                mine = np.arange(m) % blocks
                for to in range(blocks):
                    take = np.arange(m)[mine != to] if blocks > 1 else np.arange(m)
                    block = mine[take]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc[own[take]]), pa.nulls(len(take), pa.int64()), pa.array(np.full(len(take), key[s])), pa.array(np.minimum(block, to).astype(np.int32)), pa.array(np.maximum(block, to).astype(np.int32))],
                        ["a", "b", "key", "i", "j"],
                    )

    def pairs_of(a, b):
        none = pa.nulls(len(a), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none, none], ["a", "b", "key", "i", "j"])

    postings = ids.mapInArrow(post, _POSTING).repartition("key").sortWithinPartitions("key")
    met = cut(postings.mapInArrow(meet, "a long, b long, key int, i int, j int"))
    pairs = met.where("b IS NOT NULL").select("a", "b").distinct()
    if joined is not None:
        root = lambda end: joined.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        pairs = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
        pairs = pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    pairs = cut(pairs)
    crowds = met.where("b IS NULL").select(F.col("a").alias("doc_id"), "key", "i", "j")
    return verified(ids, pairs, crowds, least, shingle)


def verified(ids: DataFrame, pairs: DataFrame, crowds: DataFrame | None, least: float, shingle: int) -> DataFrame:
    """(a, b): the ``pairs`` that share ``least`` of their shingles, and pairs that span those of every crowd (key, i, j) that do."""
    crowds = ids.sparkSession.createDataFrame([], "doc_id long, key int, i int, j int") if crowds is None else crowds
    involved = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(crowds.select("doc_id"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS))
    words = involved.select(place.alias("place")).groupBy((F.col("place") / 64).cast("int").alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 AS int))")).alias("bits")).toArrow()
    bits = np.zeros(MAP_BITS // 64, np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)

    def sets(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1))
            for part in steps(batch, 1):
                found = [shingle_set(t, shingle).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["doc_id", "shingles"])

    shingles = ids.select("doc_id", "text", place).mapInArrow(sets, "doc_id long, shingles binary")

    # tasks: pairs go where the least neighbour of their two documents sends them, so that a group's sets meet once
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least_of = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    keyed = pairs.join(least_of.withColumnRenamed("m", "ma"), "a").join(least_of.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b")
    keyed = keyed.select(F.least("ma", "mb").alias("task"), "a", "b")
    crowd = keyed.groupBy("task").agg(F.ceil(F.count("*") / TASK_PAIRS).alias("blocks"))
    keyed = keyed.join(crowd, "task").select("task", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("i"), F.lit(-1).alias("j"), "a", "b")
    keyed = cut(keyed)
    wanted = keyed.select("task", "i", "j", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    wanted = wanted.unionByName(crowds.select(F.col("key").cast("long").alias("task"), "i", "j", "doc_id"))
    given = wanted.join(shingles, "doc_id").select("task", "i", "j", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "shingles")
    work = given.unionByName(keyed.select("task", "i", "j", "a", "b", F.lit(None).cast("binary").alias("shingles")))
    work = work.repartition("task", "i", "j").sortWithinPartitions("task", "i", "j")

    def verify(batches):
        """Pairs of a task that pass; in a task without pairs, pairs that span all those that pass."""
        for table in whole_runs(batches, 3):
            task, i, j, doc = (table.column(k).to_numpy() for k in range(4))
            for s, m in zip(*(x.tolist() for x in runs_of(task, i, j))):
                rows = table.slice(s, m)
                is_set = rows.column(5).is_valid().to_numpy()
                ids, found = doc[s : s + m][is_set], [np.frombuffer(x.as_py(), np.int32) for x in rows.column(5) if x.is_valid]
                if j[s] < 0:
                    at: dict[int, list] = {}
                    for k, x in zip(ids.tolist(), found):
                        at.setdefault(k, []).append(x)  # rows may share a doc_id
                    asked = zip(doc[s : s + m][~is_set].tolist(), rows.column(4).drop_null().to_pylist())
                    links = [(a, b) for a, b in asked if any(similar(p, q, least) for p in at[a] for q in at[b])]
                else:
                    links = ids[np.array(spanning(found, least), int).reshape(-1, 2)].tolist()
                if links:
                    a, b = np.array(links, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return work.mapInArrow(verify, "a long, b long")


def fingerprint_pairs(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: pairs of doc_ids that span the links of ``near_groups``: each document and the first of its fingerprint, and these by the grid join."""
    base = cut(fingerprints(docs))
    by_fp = cut(base.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = link_edges(by_fp.select(F.lit(0).alias("family"), "fp"), max_bits)
    of = lambda end: by_fp.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}"))
    across = links.join(of("a"), "a").join(of("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    both = across.unionByName(base.join(by_fp, "fp").select(F.col("first").alias("a"), F.col("doc_id").alias("b")))
    return both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar(p: np.ndarray, q: np.ndarray, least: float) -> bool:
    """Whether two sets of distinct shingles share ``least`` of their union."""
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both >= least * (len(p) + len(q) - both)


def drop_near_copies(docs: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` with one document, of the smallest doc_id, of each group of near copies.

    Near copies share at least ``least`` of their ``shingle``-word shingles, as sets of 32-bit hashes; groups
    are the components of all such pairs.  Pairs that fingerprints link (see ``near_groups``) are verified first;
    what they join needs no second look.  Most near copies' fingerprints differ in more bits, so the other
    candidates meet in their prefixes, and no pair is left out.
    Rows whose doc_id is null stay; rows that share a doc_id stay or go together.
    """
    known = docs.where("doc_id IS NOT NULL")
    ids = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    linked = cut(verified(ids, cut(fingerprint_pairs(known)), None, least, shingle))
    others = near_copy_edges(known, least, shingle, cut(components(linked)))
    joined = components(linked.unionByName(others))
    gone = joined.where("node <> root").select(F.col("node").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*columns(docs))
