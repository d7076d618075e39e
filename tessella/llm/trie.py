"""Prefix trie of conversations: distributed MSD radix partitioning, finished by multikey quicksort.

Turns are placed in order and dictionary-encoded: each distinct (role, text) has a number.  A conversation is
then a row of numbers, and a bucket is the set of conversations that share a prefix.  While a bucket has more than
``LOCAL`` turns, all large buckets take a radix step together: grouped counts find how far their
members still agree (a chain of nodes, however long, in one step), and the turn after that deals the members to new buckets.
A bucket is named by its smallest member, so dealing needs no central numbering.  Buckets that are small
enough go to a task each, where a multikey quicksort splits its members in three at every turn (less, equal, greater) and
emits a node for each equal part as it recurses.  Totals of subtrees go back up the steps, small tables joined by bucket.

No bucket, conversation or chain is gathered while it is large: chains are grouped counts, sums along them go by blocks, turns are placed
by ranges.  Only the digest of a node's own conversations is sequential by its nature; ids stream through it, in
order, eight bytes each.  The number of steps is that of the branchings on the most crowded path.

Defined results: rows whose conv_id is null take no part; a null role or text is empty; turns are ordered by turn (null
first), then role, then the SHA-256 of role and text; repeated rows are turns of their own.  Very long texts are digested whole.  An empty table
has no node, not even the root.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import positions
from .shared import cut
from .simhash import runs_of, whole_runs

#: Conversations that share their first turns with the first of so many, and the modulus of how many they share.
FAMILY, SHARED = 100, 6
#: Turns of a bucket that a task finishes alone.
LOCAL = 1 << 16
#: Places of a chain that are summed in one go.
BLOCK = 1 << 10
NONE = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0), tid (the dictionary's number of role and text), chars: whole conversations in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.char_length(role), F.lit(":"), role, text), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
    )
    placed = cut(positions(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], "pos").drop("turn", "role"))
    dictionary = cut(placed.select("digest").distinct().withColumn("tid", F.monotonically_increasing_id()))
    return cut(placed.join(dictionary, "digest").select("conv", "pos", "tid", "chars"))


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, len, pos, tid, chars) of rebuilt conversations, and (conv, len) of all.

    A conversation's first turns, up to as many as its number's CRC says, are those of its family's first.
    """
    few = own.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < SHARED))
    firsts = few.groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "tid", "chars"))).alias("firsts"))
    convs = own.groupBy("conv").agg(F.count("*").alias("n"))
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED)
    given = F.coalesce(F.slice("firsts", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<pos:bigint,tid:bigint,chars:bigint>>"))
    convs = cut(convs.join(firsts, "base", "left").select("conv", "n", "h", given.alias("given")))
    length = F.size("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    first = convs.select("conv", length.cast("long").alias("len"), F.inline("given"))
    rest = own.join(convs.select("conv", "h", F.size("given").alias("g"), length.cast("long").alias("len")), "conv").where("pos >= h")
    rest = rest.select("conv", "len", (F.col("pos") - F.col("h") + F.col("g")).cast("long").alias("pos"), "tid", "chars")
    return first.unionByName(rest), convs.select("conv", length.cast("long").alias("len"))


def sort_bucket(convs: list[int], seqs: list[list[int]]) -> tuple[list[int], list[int], list[int], list[int], list[list[int]]]:
    """Nodes of conversations (in ascending order) that share their first turn, parents before children.

    Of each node: its smallest member's index, depth (of the first: 1), parent (of the first: -1), number of members,
    and the members that end there.
    """
    low, depths, parents, sizes, ends = [], [], [], [], []
    stack = [(list(range(len(convs))), 0, -1)]
    while stack:
        items, d, node = stack.pop()
        if len(items) == 1:
            i = items[0]
            n, at = len(seqs[i]) - d, len(low)
            low += [i] * n
            depths += range(d + 1, d + n + 1)
            parents += [node, *range(at, at + n - 1)][:n]
            sizes += [1] * n
            ends += [[] for _ in range(n)]
            ends[-1 if n else node].append(i)
            continue
        pivot = seqs[items[len(items) // 2]]
        pivot = pivot[d] if d < len(pivot) else -1
        less, same, more = [], [], []
        for i in items:
            key = seqs[i][d] if d < len(seqs[i]) else -1
            (same if key == pivot else less if key < pivot else more).append(i)
        if less:
            stack.append((less, d, node))
        if more:
            stack.append((more, d, node))
        if pivot < 0:
            ends[node] += same
        else:
            stack.append((same, d + 1, len(low)))
            low.append(same[0])
            depths.append(d + 1)
            parents.append(node)
            sizes.append(len(same))
            ends.append([])
    return low, depths, parents, sizes, ends


def digest(convs) -> str:
    """SHA-256 of decimal numbers, comma-joined."""
    return hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()


def finished(batches):
    """Nodes of whole buckets, sorted by step, bucket, conversation and position."""
    for table in whole_runs(batches, 2):
        step, bucket, conv, pos, tid, chars, parent = (table.column(k).to_numpy() for k in range(7))
        out = {k: [] for k in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "step", "top")}
        for s, m in zip(*(x.tolist() for x in runs_of(step, bucket))):
            start, sizes = runs_of(conv[s : s + m])
            ids = conv[s : s + m][start].tolist()
            seqs = [x.tolist() for x in np.split(tid[s : s + m], start[1:])]
            lengths = [x.tolist() for x in np.split(chars[s : s + m], start[1:])]
            low, depths, parents, n, ends = sort_bucket(ids, seqs)
            leaves, saved, children = [0] * len(low), [0] * len(low), [0] * len(low)
            for k in range(len(low) - 1, -1, -1):
                leaves[k] = leaves[k] or 1
                saved[k] += (n[k] - 1) * lengths[low[k]][depths[k] - 1]
                if parents[k] >= 0:
                    children[parents[k]] += 1
                    leaves[parents[k]] += leaves[k]
                    saved[parents[k]] += saved[k]
            above = int(pos[s])
            out["conv_id"] += [ids[i] for i in low]
            out["depth"] += [above + d for d in depths]
            out["parent_conv_id"] += [ids[low[p]] if p >= 0 else int(parent[s]) for p in parents]
            out["n_convs"] += n
            out["n_children"] += children
            out["n_leaves"] += leaves
            out["saved_tokens"] += saved
            out["ends_sha256"] += [digest(ids[i] for i in sorted(e)) if e else NONE for e in ends]
            out["step"] += [int(step[s])] * len(low)
            out["top"] += [p < 0 for p in parents]
        yield pa.RecordBatch.from_pydict(out, schema=_FINISHED)


_FINISHED = pa.schema(
    [(k, pa.int64()) for k in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("step", pa.int64()), ("top", pa.bool_())]
)


def streamed_digests(batches):
    """bucket, SHA-256 of its conversations' numbers; batches are sorted by bucket and number."""
    at, state = None, None
    for batch in batches:
        bucket, conv = (batch.column(k).to_numpy() for k in range(2))
        for s, m in zip(*(x.tolist() for x in runs_of(bucket))) if len(bucket) else ():
            joined = ",".join(map(str, conv[s : s + m].tolist())).encode()
            if at == int(bucket[s]):
                state.update(b"," + joined)
                continue
            if state:
                yield pa.RecordBatch.from_pydict({"bucket": [at], "sha": [state.hexdigest()]})
            at, state = int(bucket[s]), hashlib.sha256(joined)
    if state:
        yield pa.RecordBatch.from_pydict({"bucket": [at], "sha": [state.hexdigest()]})


def sums_from_here(chain: DataFrame) -> DataFrame:
    """``chain(bucket, depth, own)`` with ``below``: the sum of own over this and all deeper places of its bucket, by blocks."""
    blocks = chain.groupBy("bucket", (F.col("depth") / BLOCK).cast("long").alias("block")).agg(F.sum("own").alias("own"))
    later = Window.partitionBy("bucket").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    after = blocks.select("bucket", "block", F.coalesce(F.sum("own").over(later), F.lit(0)).alias("after"))
    here = Window.partitionBy("bucket", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    inside = chain.withColumn("block", (F.col("depth") / BLOCK).cast("long")).withColumn("inside", F.sum("own").over(here))
    return inside.join(after, ["bucket", "block"]).withColumn("below", F.col("inside") + F.col("after")).drop("block", "inside", "after", "own")


def step(rows: DataFrame, buckets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A radix step of large buckets.

    ``rows(bucket, top, conv, len, pos, tid, chars)`` from the turn above the bucket's first node, and
    ``buckets(bucket, top, parent, n_convs)``.  Gives branches (buckets with ``at``, the depth to which members agree), chain nodes
    (bucket, depth, chars, n_convs), the members that end at a branch (bucket, conv), and the rows of the new buckets.
    """
    counts = rows.groupBy("bucket", "pos").agg(F.count("*").alias("n"), F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.min("chars").alias("chars"))
    counts = cut(counts.join(buckets.select("bucket", "n_convs"), "bucket"))
    parts = F.when((F.col("n") < F.col("n_convs")) | (F.col("lo") != F.col("hi")), F.col("pos"))
    reached = counts.groupBy("bucket").agg(F.coalesce(F.min(parts), F.max("pos") + 1).alias("at"))
    branches = cut(buckets.join(reached, "bucket", "left").withColumn("at", F.coalesce("at", "top")))
    at = branches.select("bucket", "at")
    chain = counts.join(at, "bucket").where("pos < at").select("bucket", (F.col("pos") + 1).alias("depth"), "chars", "n_convs")
    inside = rows.join(at, "bucket")
    ends = inside.where("pos = at - 1 AND len = at").select("bucket", "conv")
    dealt = inside.where("pos = at").select("bucket", "tid", "conv", "len", "at")
    kids = dealt.groupBy("bucket", "tid").agg(F.min("conv").alias("child"), F.count("*").alias("kid_convs"), F.sum(F.col("len") - F.col("at")).alias("kid_rows"))
    to = cut(dealt.join(kids, ["bucket", "tid"]).select("conv", F.col("bucket").alias("parent"), F.col("child").alias("bucket"), (F.col("at") + 1).alias("top"), "kid_convs", "kid_rows"))
    new = rows.drop("bucket", "top", "parent", "n_convs", "n_rows").join(to, "conv").where("pos >= top - 1")
    new = new.select("bucket", "top", "parent", F.col("kid_convs").alias("n_convs"), F.col("kid_rows").alias("n_rows"), "conv", "len", "pos", "tid", "chars")
    return branches, chain, ends, cut(new)


def nodes(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    spark = conversations.sparkSession
    turns_of, convs = rebuilt(turns(conversations))
    convs = cut(convs)
    root, n = convs.agg(F.min("conv"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], _NODE)
    large = cut(turns_of.withColumn("bucket", F.lit(root).cast("long")).withColumn("top", F.lit(0).cast("long")))
    buckets = spark.createDataFrame([(root, 0, None, n)], "bucket long, top long, parent long, n_convs long")
    turnless = convs.where("len = 0").select(F.lit(root).cast("long").alias("bucket"), "conv")
    done, small, k = [], [], 0
    while True:
        branches, chain, ends, new = step(large, buckets)
        if not k:
            chain = chain.unionByName(buckets.select("bucket", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "n_convs"))
            ends = ends.unionByName(turnless)
        done.append((branches, chain, ends))
        small.append(new.where(F.col("n_rows") <= local).select(F.lit(k).cast("long").alias("step"), "bucket", "conv", "pos", "tid", "chars", "parent"))
        large = new.where(F.col("n_rows") > local)
        if large.isEmpty():
            break
        buckets = cut(large.groupBy("bucket").agg(F.first("top").alias("top"), F.first("parent").alias("parent"), F.first("n_convs").alias("n_convs")))
        k += 1
    rows = small[0]
    for more in small[1:]:
        rows = rows.unionByName(more)
    rows = rows.repartition("step", "bucket").sortWithinPartitions("step", "bucket", "conv", "pos")
    leaves = cut(rows.mapInArrow(finished, _NODE + ", step long, top boolean"))
    result = leaves.select(*[c.split()[0] for c in _NODE.split(", ")])
    tops = leaves.where("top").select("step", F.col("parent_conv_id").alias("bucket"), "n_leaves", "saved_tokens")
    above = None
    for k in range(len(done) - 1, -1, -1):
        branches, chain, ends = done[k]
        own = tops.where(F.col("step") == k).drop("step")
        own = own.unionByName(above) if above is not None else own
        below = own.groupBy("bucket").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("under"))
        ended = ends.repartition("bucket").sortWithinPartitions("bucket", "conv").mapInArrow(streamed_digests, "bucket long, sha string")
        facts = branches.join(below, "bucket", "left").join(ended, "bucket", "left").select(
            "bucket", "top", "parent", "at", F.coalesce("kids", F.lit(0)).alias("kids"), F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("under", F.lit(0)).alias("under"), "sha"
        )
        path = sums_from_here(chain.withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))).join(facts, "bucket")
        last, first = F.col("depth") == F.col("at"), F.col("depth") == F.col("top")
        path = cut(
            path.select(
                F.col("bucket").alias("conv_id"),
                "depth",
                F.when(first, F.col("parent")).otherwise(F.col("bucket")).alias("parent_conv_id"),
                "n_convs",
                F.when(last, F.col("kids")).otherwise(1).alias("n_children"),
                F.col("leaves").alias("n_leaves"),
                (F.col("below") + F.col("under")).alias("saved_tokens"),
                F.when(last & F.col("sha").isNotNull(), F.col("sha")).otherwise(NONE).alias("ends_sha256"),
                first.alias("top"),
            )
        )
        above = path.where("top").select(F.col("parent_conv_id").alias("bucket"), "n_leaves", "saved_tokens")
        result = result.unionByName(path.drop("top"))
    return result


SQL = """
WITH bytes AS (
  SELECT DISTINCT conv_id, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x:
           list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z:
             CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END))) % {shared} AS h
  FROM bytes),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY pos) AS l FROM own GROUP BY conv_id),
whole AS (
  SELECT c.conv_id, list_concat(coalesce(f.l[1:c.h], []), o.l[c.h + 1:]) AS l
  FROM crc c JOIN lists o ON o.conv_id = c.conv_id LEFT JOIN lists f ON f.conv_id = c.conv_id - c.conv_id % {family}),
prefix AS (
  SELECT conv_id, d, CASE WHEN d = 0 THEN '' ELSE sha256(l[1:d]::JSON::VARCHAR) END AS k, CASE WHEN d = 0 THEN 0 ELSE length(l[d].t) END AS chars, len(l) AS n
  FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM whole)),
member AS (SELECT *, min(conv_id) OVER (PARTITION BY d, k) AS low FROM prefix),
node AS (
  SELECT low AS conv_id, d AS depth, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM member GROUP BY low, d),
linked AS (
  SELECT node.*, m.low AS parent_conv_id FROM node LEFT JOIN member m ON m.conv_id = node.conv_id AND m.d = node.depth - 1),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT l.*, coalesce(k.n_children, 0) AS n_children FROM linked l LEFT JOIN kids k USING (conv_id, depth)),
sub AS (
  SELECT m.low AS conv_id, m.d AS depth, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved_tokens
  FROM full_node f JOIN member m ON m.conv_id = f.conv_id AND m.d <= f.depth GROUP BY ALL)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_node f JOIN sub s USING (conv_id, depth)
""".format(shared=SHARED, family=FAMILY)
