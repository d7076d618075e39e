"""Approximate nearest neighbours by largest inner product: robust-pruned directed graphs in shards.

Equal vectors are one node that carries its smallest identifiers, so that copies neither fill a
neighbour list nor a beam.  Nodes are dealt to shards by a hash of the vector; every node is indexed.
Inner products become distances by one more coordinate, ``sqrt(M^2 - |x|^2)`` with M the largest norm,
after which all nodes have norm M and a query (with 0 there) is nearest to the largest inner product.

A shard's graph is built by insertion in growing batches: a greedy search for each new node proposes
its neighbours (all nodes the beam met), relaxed pruning keeps the nearest ones that are not ``ALPHA``
times closer to a neighbour kept before, and the reverse edges are added and pruned alike.  The graph
is stored, then beam search runs every query through every shard; found nodes are ranked by their
exact inner products in double precision and the shards' best are merged.

Defined results: rows whose vec_id or vector is null, and vectors that are empty, zero, hold null or
non-finite components, or have another length than most, take no part; of rows that share a vec_id the
one with the smallest vector counts; of equal products the smaller vec_id comes first; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

DEGREE, BUILD_BEAM, BEAM, WIDTH, ALPHA = 32, 64, 128, 4, 1.2
#: Nodes in a shard and queries in a group, about; long vectors make shards smaller, to this many bytes.
SHARD, QUERIES, SHARD_BYTES = 16_384, 8_192, 64 << 20
#: Queries searched at a time: bounds memory.
STEP = 512


class Graph:
    """Nodes' vectors (of equal norm) and at most DEGREE out-edges of each; -1 fills up."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None, start: int = 0):
        self.x, self.start = np.ascontiguousarray(x, np.float32), start
        self.edges = np.full((len(x), DEGREE), -1, np.int32) if edges is None else edges

    def search(self, q: np.ndarray, beam: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``beam`` best nodes met, best first (-1 where there are fewer), and their products."""
        n, rows = len(q), np.arange(len(q))[:, None]
        ids = np.full((n, beam), -1, np.int32)
        score = np.full((n, beam), -np.inf, np.float32)
        done = np.ones((n, beam), bool)
        ids[:, 0], score[:, 0], done[:, 0] = self.start, q @ self.x[self.start], False
        alive = np.arange(n)
        while len(alive):
            a_ids, a_score, a_done = ids[alive], score[alive], done[alive]
            r = rows[: len(alive)]
            pick = np.argsort(np.where(a_done, 1, 0), axis=1, kind="stable")[:, :width]  # best first: rows are sorted
            fresh = ~a_done[r, pick]
            nodes = np.where(fresh, a_ids[r, pick], -1)
            a_done[r, pick] = True
            near = np.where(nodes[:, :, None] >= 0, self.edges[nodes], -1).reshape(len(alive), -1)
            found = np.einsum("qkd,qd->qk", self.x[near], q[alive], optimize=True)
            found[near < 0] = -np.inf
            all_ids = np.concatenate((a_ids, near), 1)
            all_score = np.concatenate((a_score, found), 1)
            all_done = np.concatenate((a_done, np.zeros(near.shape, bool)), 1)
            # a node met again gives way to its earlier entry
            by_id = np.argsort(all_ids, axis=1, kind="stable")
            sorted_ids = all_ids[r, by_id]
            again = np.zeros(sorted_ids.shape, bool)
            again[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
            all_score[r, by_id] = np.where(again, -np.inf, all_score[r, by_id])
            best = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
            a_score = all_score[r, best]
            a_ids = np.where(np.isfinite(a_score), all_ids[r, best], -1)
            a_done = all_done[r, best] | (a_ids < 0)
            ids[alive], score[alive], done[alive] = a_ids, a_score, a_done
            alive = alive[~a_done.all(axis=1)]
        return ids, score

    def prune(self, at: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """DEGREE candidates of each node of ``at``, by relaxed pruning; candidates may repeat or be -1."""
        r = np.arange(len(at))[:, None]
        c = np.sort(candidates, axis=1)
        bad = (c < 0) | (c == at[:, None])
        bad[:, 1:] |= c[:, 1:] == c[:, :-1]
        vectors = self.x[np.where(bad, 0, c)]
        norm = float(self.x[0] @ self.x[0])
        far = 2 * norm - 2 * np.einsum("bkd,bd->bk", vectors, self.x[at], optimize=True)
        far[bad] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        c, far, vectors = c[r, order], far[r, order], vectors[r, order]
        between = 2 * norm - 2 * (vectors @ vectors.transpose(0, 2, 1))
        open_, out, line = np.isfinite(far), np.full((len(at), DEGREE), -1, np.int32), np.arange(len(at))
        for k in range(DEGREE):
            first = open_.argmax(axis=1)
            live = open_[line, first]
            if not live.any():
                break
            out[live, k] = c[line, first][live]
            open_ &= ALPHA**2 * between[line, first] > far
            open_[line, first] = False
        return out

    def build(self, seed: int = 11) -> "Graph":
        n = len(self.x)
        if n <= 1:
            return self
        centre = self.x.mean(0)
        self.start = int((self.x @ centre).argmax())
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        order = np.concatenate(([self.start], order[order != self.start])).astype(np.int32)
        done = 1
        while done < n:
            new = order[done : done + max(1, min(STEP, done // 4))]
            found, _ = self.search(self.x[new], BUILD_BEAM)
            self.edges[new] = self.prune(new, found)
            self._reverse(new)
            done += len(new)
        return self

    def _reverse(self, new: np.ndarray) -> None:
        source = np.repeat(new, DEGREE)
        target = self.edges[new].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        while len(target):
            first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
            at = target[first]
            rank = np.arange(len(target)) - np.repeat(first, np.diff(np.concatenate((first, [len(target)]))))
            now = rank < DEGREE  # of a node that many point to, so many at a time
            added = np.full((len(at), DEGREE), -1, np.int32)
            added[np.searchsorted(at, target[now]), rank[now]] = source[now]
            both = np.concatenate((self.edges[at], added), 1)
            room = (both >= 0).sum(1) <= DEGREE
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :DEGREE]
            self.edges[at[room]] = packed[room]
            full = np.flatnonzero(~room)
            for k in range(0, len(full), STEP):
                self.edges[at[full[k : k + STEP]]] = self.prune(at[full[k : k + STEP]], both[full[k : k + STEP]])
            source, target = source[~now], target[~now]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().astype(np.float64).reshape(len(flat), -1)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
        & F.exists("v", lambda x: x != 0)
    )
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row with ``vec_id % every == 0``."""
    rows = cut(usable(embeddings))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m"))
    most = dims.orderBy(F.desc("n"), "d").first()
    if most is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, m = most["d"], float(most["m"])
    rows = rows.where(F.size("v") == d)
    # equal vectors: one node with its k + 1 smallest ids; the others are cut by rank in every partition before the shuffle
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    nodes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = cut(nodes.withColumn("key", F.xxhash64("v")))
    shards = max(1, -(-nodes.count() // min(shard, max(1_024, SHARD_BYTES // (8 * d)))))
    asked = rows.where(F.col("vec_id") % every == 0)
    questions = cut(asked.groupBy("v").agg(F.min("vec_id").alias("key")))  # queries with equal vectors are searched once
    asked = asked.join(questions, "v").select("vec_id", "key")
    groups = max(1, -(-questions.count() // QUERIES))

    def lift(x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.maximum(0, m - (x * x).sum(1)))))

    def build(table: pa.Table) -> pa.Table:
        x = _matrix(table["v"])
        order = np.lexsort(x.T[::-1])  # the same graph in every run
        x, ids = x[order], table["ids"].take(pa.array(order))
        graph = Graph(lift(x)).build()
        row = {"shard": [table["shard"][0].as_py()], "x": [x.tobytes()], "edges": [graph.edges.tobytes()], "start": [graph.start], "ids": [ids.to_pylist()]}
        return pa.table(row, schema=pa.schema([("shard", pa.int32()), ("x", pa.binary()), ("edges", pa.binary()), ("start", pa.int32()), ("ids", pa.list_(pa.list_(pa.int64())))]))

    dealt = nodes.withColumn("shard", F.pmod(F.col("key"), F.lit(shards)).cast("int"))
    index = cut(dealt.groupBy("shard").applyInArrow(build, "shard int, x binary, edges binary, start int, ids array<array<long>>"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(left) or not len(right):
            return schema.empty_table()
        x = np.frombuffer(left["x"][0].as_py(), np.float64).reshape(-1, d)
        graph = Graph(lift(x), np.frombuffer(left["edges"][0].as_py(), np.int32).reshape(-1, DEGREE), left["start"][0].as_py())
        ids = left["ids"][0].as_py()
        q, keys = _matrix(right["v"]), right["key"].to_numpy()
        key_out, id_out, score_out = [], [], []
        for at in range(0, len(q), STEP):
            part = q[at : at + STEP]
            found, _ = graph.search(np.column_stack((part, np.zeros(len(part)))).astype(np.float32), max(beam, k + 1))
            exact = np.where(found >= 0, np.einsum("qkd,qd->qk", x[found], part), -np.inf)
            for i in range(len(part)):
                rows_ = sorted(((-s, v) for s, node in zip(exact[i].tolist(), found[i].tolist()) if node >= 0 for v in ids[node]))[: k + 1]
                key_out += [keys[at + i]] * len(rows_)
                score_out += [-s for s, _ in rows_]
                id_out += [v for _, v in rows_]
        return pa.table({"key": pa.array(key_out, pa.int64()), "vec_id": pa.array(id_out, pa.int64()), "score": pa.array(score_out, pa.float64())})

    to_all = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    by_group = questions.select("key", "v").withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")).select("*", to_all.alias("shard"))
    copies = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    met = copies.groupBy("shard", "group").cogroup(by_group.groupBy("shard", "group")).applyInArrow(search, "key long, vec_id long, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("r") <= k + 1)
    answers = asked.select(F.col("vec_id").alias("query_id"), "key").join(best, "key").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return answers.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
