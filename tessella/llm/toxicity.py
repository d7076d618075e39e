"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct words (lower case, without punctuation) and the words' first five
letters, each as a 64-bit hash.  The machine scores ``w0 + sum w_i x_i + sum_{i<j} sum_f s_f v_if v_jf x_i x_j``
with ``x_i`` 1 for the terms present, so a pair of terms can weigh more than both alone.  Half of the signs ``s_f`` are
negative: without them two words of one group could never weigh less together than a word of each of two groups.

Fitting uses a bounded sample: at most about ``SAMPLE`` labelled documents of each class, chosen by a
hash of doc_id.  A term enters the machine in one of four ways.  Its document frequencies in the two classes differ.  Or
it is part of a pair whose effect is more than the sum of its terms' (the contrast of log odds with both, either and none of them;
all pairs of terms that are each in ``PAIR_SHARE`` of the sample).  Or it is one of many words that tell only together with many others,
none of whose pairs is frequent enough to be seen: the matrix of all pairs' joint class differences then has
an eigenvalue above those of shuffled labels, and its eigenvectors name the words.  Or it explains what the machine so far
does not: its gradient, alone or with a factor, differs from chance on the residuals.  Nothing caps the number of terms; collisions are
avoided by keeping the selected hashes themselves.  Scoring reads whole texts.

Defined results: null and empty texts score as texts without terms; very long texts count each term once;
repeated rows score alike and their text counts once in the fit; documents with a null doc_id are
scored and never fitted on; several labels of one document count as toxic if any is; labels without
both classes (or none at all) give every text the score of the class there is (0 if there is none); other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Labelled documents of each class that are fitted on, about.
SAMPLE = 4_000
#: The least z of a term's class difference, and its documents in the sample.
LEAST_Z, LEAST_DF = 4.0, 4
#: The least z of a pair's contrast, and the documents of either term: a number, and a share of the sample.
PAIR_Z, PAIR_DF, PAIR_SHARE = 6.0, 24, 1 / 40
#: Terms whose pairs with all others are tested at a time: bounds the driver's memory.
PAIR_STEP = 256
#: Rows of the sample that are laid out at a time, by all frequent terms and by their own terms.
PAIR_ROWS, SUM_ROWS = 1_024, 256
#: Eigenvectors that are looked at, how far above shuffled labels' an eigenvalue must be, and a word's least part in them, in times the mean.
GROUPS, ABOVE, LOAD = 6, 1.05, 2.5
#: Rounds of residual gradients, the least z of one, the steps of the fits between, and rounds without a gain that are allowed.
ROUNDS, GRADIENT_Z, ROUND_STEPS, PATIENCE = 12, 4.0, 1_000, 2
SIGNS = np.array([1.0, 1.0, -1.0, -1.0])
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.1, 1e-4
#: Steps that a fit takes at least: small samples are gone through more often.
STEPS = 4_000
PREFIX = 5
#: Words a cache of a worker may hold.
CACHE = 100_000
_WORDS = re.compile(r"[^\W_]+")


def hashed(term: str, kind: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}:{term}") - (1 << 63)


class Terms(dict):
    """raw word -> values of its terms, by ``of(hash)``; bounded."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, raw: str):
        hashes = [h for w in _WORDS.findall(raw) for h in (hashed(w, "w"), hashed(w[:PREFIX], "p"))]
        value = tuple(x for x in map(self.of, hashes) if x is not None)
        if len(self) >= CACHE:
            self.clear()
        if len(raw) <= 64:
            self[raw] = value
        return value

    def __call__(self, text: str | None) -> list[int]:
        found: set[int] = set()
        for value in filter(None, map(self.__getitem__, set((text or "").lower().split()))):
            found.update(value)
        return sorted(found)


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values[starts[i]:starts[i + 1]]``, along the first axis."""
    sums = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)))
    return sums[starts[1:]] - sums[starts[:-1]]


class Bags:
    """Texts as the places of their terms, one after the other."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat.astype(np.int32), lengths.astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.owner = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)

    @classmethod
    def of(cls, rows: list) -> Bags:
        lengths = np.array([len(r) for r in rows], np.int64)
        return cls(np.fromiter(chain.from_iterable(rows), np.int64, int(lengths.sum())), lengths)

    def __len__(self) -> int:
        return len(self.lengths)

    def rows(self, keep: np.ndarray) -> Bags:
        """The texts that ``keep`` marks."""
        return Bags(self.flat[keep[self.owner]], self.lengths[keep])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of its terms' rows of ``values``; some texts at a time."""
        out = np.zeros((len(self), *values.shape[1:]))
        for at in range(0, len(self), SUM_ROWS):
            starts = self.starts[at : at + SUM_ROWS + 1]
            out[at : at + SUM_ROWS] = segment_sums(values[self.flat[starts[0] : starts[-1]]], starts - starts[0])
        return out

    def only(self, picked: np.ndarray, n_terms: int) -> Bags:
        """With the terms ``picked`` alone, by their places in it."""
        new = np.full(n_terms, -1, np.int32)
        new[picked] = np.arange(len(picked))
        flat = new[self.flat]
        return Bags(flat[flat >= 0], np.bincount(self.owner[flat >= 0], minlength=len(self)))


@dataclass(frozen=True)
class Machine:
    """A fitted model; small enough to travel with a task: the sample bounds its terms."""

    terms: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, rows: list[list[int]]) -> np.ndarray:
        """Of many texts at once, each given by the places of its terms."""
        bags = Bags.of(rows)
        return logits_of(bags, self.w0, self.w, self.v)

    def logit(self, present: list[int]) -> float:
        return float(self.logits([present])[0])


def logits_of(bags: Bags, w0: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    pairs = (bags.sums(v) ** 2 - bags.sums(v**2)) @ SIGNS
    return w0 + bags.sums(w) + 0.5 * pairs


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights with which the two classes weigh the same."""
    return np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)


def fit(bags: Bags, y: np.ndarray, n_terms: int, steps: int = STEPS, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """AdaGrad on the logistic loss; the two classes weigh the same."""
    rng = np.random.default_rng(seed)
    factors = len(SIGNS)
    w0, w, v = 0.0, np.zeros(n_terms), rng.normal(0, 0.1, (n_terms, factors))
    g0, gw, gv = 1e-8, np.full(n_terms, 1e-8), np.full((n_terms, factors), 1e-8)
    lengths, starts, flat, weight = bags.lengths, bags.starts, bags.flat, balanced(y)
    for _ in range(max(EPOCHS * steps // STEPS, steps * BATCH // max(1, len(y)), 1)):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            idx = np.concatenate([flat[starts[d] : starts[d + 1]] for d in docs])
            owner = np.repeat(np.arange(len(docs)), lengths[docs])
            sums = np.zeros((len(docs), factors))
            np.add.at(sums, owner, v[idx])
            squares = np.zeros((len(docs), factors))
            np.add.at(squares, owner, v[idx] ** 2)
            z = w0 + np.bincount(owner, w[idx], len(docs)) + 0.5 * (sums**2 - squares) @ SIGNS
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs]) * weight[docs] / len(docs)
            d_w = np.bincount(idx, err[owner], n_terms).astype(float)
            d_v = np.zeros_like(v)
            np.add.at(d_v, idx, err[owner, None] * (sums[owner] - v[idx]) * SIGNS)
            touched = np.unique(idx)
            d_w[touched] += DECAY * w[touched]
            d_v[touched] += DECAY * v[touched]
            d_0 = err.sum()
            g0 += d_0**2
            gw += d_w**2
            gv += d_v**2
            w0 -= RATE * d_0 / np.sqrt(g0)
            w -= RATE * d_w / np.sqrt(gw)
            v -= RATE * d_v / np.sqrt(gv)
    return w0, w, v


def telling_pairs(bags: Bags, y: np.ndarray, n_terms: int, candidates: np.ndarray, least: float = PAIR_Z) -> np.ndarray:
    """The terms of all pairs of ``candidates`` whose joint effect isn't the sum of their own.

    The effect is the log odds of class 1 with both terms, less those with either alone, plus those with
    neither; its z comes from the counts of the eight cells, each a half larger.  Only ``PAIR_ROWS`` texts and the counts
    of ``PAIR_STEP`` terms with all are laid out at a time.
    """
    own_bags = bags.only(candidates, n_terms)
    found, m = np.zeros(len(candidates), bool), len(candidates)
    for k in range(0, m, PAIR_STEP):
        width = min(PAIR_STEP, m - k)
        both = np.zeros((2, width, m), np.float32)
        for at in range(0, len(bags), PAIR_ROWS):
            a, b = own_bags.starts[at], own_bags.starts[min(at + PAIR_ROWS, len(bags))]
            for c in (0, 1):
                mine = y[own_bags.owner[a:b]] == c
                has = np.zeros((PAIR_ROWS, m), np.float32)
                has[own_bags.owner[a:b][mine] - at, own_bags.flat[a:b][mine]] = 1
                both[c] += has[:, k : k + width].T @ has
        effect, spread = 0.0, 0.0
        for c, sign in ((0, -1), (1, 1)):
            total, n = np.bincount(own_bags.flat[y[own_bags.owner] == c], minlength=m).astype(np.float32), float((y == c).sum())
            first, second = total[k : k + width, None] - both[c], total[None] - both[c]
            for s, cell in ((1, both[c]), (-1, first), (-1, second), (1, n - both[c] - first - second)):
                effect = effect + sign * s * np.log(cell + 0.5)
                spread = spread + 1 / (cell + 0.5)
        z = np.abs(effect) / np.sqrt(spread)
        z[np.arange(width), k + np.arange(width)] = 0
        found |= (z >= least).any(0)
        found[k : k + width] |= (z >= least).any(1)
    return candidates[found]


def eigenvectors(bags: Bags, r: np.ndarray, n_terms: int, candidates: np.ndarray, k: int = GROUPS, rounds: int = 12, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, by size, and eigenvectors of the pairs' matrix: sums over the texts of ``r`` times both terms' standardised presence.

    The diagonal, which is no pair, is left out.  The matrix is never laid out: texts' terms are summed instead.
    """
    own, m = bags.only(candidates, n_terms), len(candidates)
    k = min(k, m)
    p = np.bincount(own.flat, minlength=m) / len(own)
    scale = 1 / np.sqrt(np.maximum(p * (1 - p), 1e-9))
    mean = p * scale
    r = r - r.mean()
    r = r / max(np.sqrt((r**2).sum()), 1e-30)
    diagonal = np.bincount(own.flat, r[own.owner], m) * ((scale - mean) ** 2 - mean**2)

    def times(q: np.ndarray) -> np.ndarray:
        found = r[:, None] * (own.sums(scale[:, None] * q) - mean @ q)
        by_term = np.stack([np.bincount(own.flat, found[own.owner, c], m) for c in range(q.shape[1])], 1)
        return scale[:, None] * by_term - mean[:, None] * found.sum(0) - diagonal[:, None] * q

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, k)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(times(times(q)))[0]
    small = q.T @ times(q)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    by_size = np.argsort(-np.abs(values))
    return values[by_size], (q @ turn)[:, by_size]


def telling_groups(bags: Bags, r: np.ndarray, n_terms: int, candidates: np.ndarray) -> np.ndarray:
    """The ``candidates`` whose pairs together explain the residuals ``r``, though no single pair may."""
    if len(candidates) < 2:
        return candidates[:0]
    values, vectors = eigenvectors(bags, r, n_terms, candidates)
    chance = np.abs(eigenvectors(bags, np.random.default_rng(1).permutation(r), n_terms, candidates)[0][0])
    part = np.abs(vectors) * np.sqrt(len(candidates))
    return candidates[(part[:, np.abs(values) > ABOVE * chance] >= LOAD).any(1)]


def residuals(bags: Bags, y: np.ndarray, machine: tuple[float, np.ndarray, np.ndarray]) -> np.ndarray:
    """What the machine leaves of the labels; the classes weigh the same."""
    return (y - 1 / (1 + np.exp(-np.clip(logits_of(bags, *machine), -30, 30)))) * balanced(y)


def loss(bags: Bags, y: np.ndarray, machine: tuple[float, np.ndarray, np.ndarray]) -> float:
    """The mean logistic loss; the classes weigh the same."""
    z = np.clip(logits_of(bags, *machine), -30, 30)
    return float(np.mean(balanced(y) * (np.logaddexp(0, z) - y * z)))


def unexplained(bags: Bags, y: np.ndarray, n_terms: int, picked: np.ndarray, candidates: np.ndarray, machine: tuple[float, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ``candidates`` whose gradient, alone or with a factor of ``machine`` (over ``picked``), differs from chance."""
    inside, v = bags.only(picked, n_terms), machine[2]
    r = residuals(inside, y, machine)
    with_ = np.concatenate((np.ones((len(bags), 1)), inside.sums(v)), 1)
    with_[:, 1:] -= with_[:, 1:].mean(0)
    g = r[:, None] * with_
    g -= g.mean(0)
    p = np.bincount(bags.flat, minlength=n_terms) / len(bags)
    sums = np.stack([np.bincount(bags.flat, g[bags.owner, k], n_terms) for k in range(g.shape[1])], 1)
    z = np.abs(sums) / np.sqrt(np.maximum((p * (1 - p))[:, None] * (g**2).sum(0), 1e-12))
    return candidates[(z[candidates] >= GRADIENT_Z).any(1)]


def selected(bags: Bags, y: np.ndarray, alone: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The places of the terms that enter the machine; ``alone``: those that tell by themselves, ``known``: each term's texts.

    Groups and gradients add terms round by round, as long as a fifth of the sample, on which none is fitted, is explained better.
    """
    n_terms, often = len(known), max(PAIR_DF, PAIR_SHARE * len(bags))
    some, many = np.flatnonzero(known >= PAIR_DF), np.flatnonzero(known >= often)
    best = picked = np.union1d(np.flatnonzero(alone), telling_pairs(bags, y, n_terms, many))
    test = np.random.default_rng(5).permutation(len(bags)) % 5 == 0
    inner, outer = bags.rows(~test), bags.rows(test)
    if not y[test].any() or y[test].all():
        return best
    least, worse = np.inf, 0
    for number in range(ROUNDS):
        machine = fit(inner.only(picked, n_terms), y[~test], len(picked), ROUND_STEPS)
        now = loss(outer.only(picked, n_terms), y[test], machine)
        best, least, worse = (picked, now, 0) if now < least else (best, least, worse + 1)
        if worse > PATIENCE:
            break
        more = unexplained(inner, y[~test], n_terms, picked, some, machine)
        if not number:
            r = residuals(inner.only(picked, n_terms), y[~test], machine)
            more = np.concatenate((more, *[telling_groups(inner, r, n_terms, c) for c in (many, some)]))
        more = np.setdiff1d(more, picked)
        if not len(more):
            break
        picked = np.union1d(picked, more)
    return best


def held_out(doc_id: Column) -> Column:
    """Documents never fitted on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine fitted on the sample; see the module's docstring."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return Machine(np.zeros(0, np.int64), 30.0 if set(sizes) == {1} else -30.0, np.zeros(0), np.zeros((0, len(SIGNS))))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(sample)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("toxic") == 1, sample / sizes[1]).otherwise(sample / sizes[0])
    chosen = known.where(draw < share)  # about 2 * sample short rows at most: bounded, so it may be broadcast

    def to_terms(batches):
        terms = Terms(lambda h: h)
        for batch in batches:
            found = [terms(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["toxic", "terms"])

    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # copies of a text count once: else their rare words would look telling
    bags = cut(texts.select("toxic", "text").mapInArrow(to_terms, "toxic int, terms array<long>").distinct())
    n = {r["toxic"]: r["n"] for r in bags.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(n) != {0, 1}:
        return Machine(np.zeros(0, np.int64), 30.0 if set(n) == {1} else -30.0, np.zeros(0), np.zeros((0, len(SIGNS))))
    n1, n0 = float(n[1]), float(n[0])
    df = bags.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")
    )
    pooled = (F.col("t") + F.col("c")) / (n1 + n0)
    z = F.abs(F.col("t") / n1 - F.col("c") / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    number = F.col("t") + F.col("c")
    seen = df.where(number >= LEAST_DF).select("term", (z >= LEAST_Z).alias("alone"), number.cast("long").alias("n"))
    seen = seen.where(F.col("alone") | (F.col("n") >= PAIR_DF)).orderBy("term").toArrow()  # the sample bounds them
    known, alone, texts_of = (seen[c].to_numpy() for c in ("term", "alone", "n"))

    def to_places(batches):
        """Terms as places in ``known``; those outside it go."""
        for batch in batches:
            found = []
            for terms in batch.column(1):
                h = np.array(terms.as_py(), np.int64)
                at = np.searchsorted(known, h).clip(max=max(0, len(known) - 1))
                found.append(np.unique(at[known[at] == h]).astype(np.int32) if len(known) else at[:0].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["toxic", "places"])

    placed = bags.mapInArrow(to_places, "toxic int, places array<int>")
    placed = placed.orderBy("toxic", F.xxhash64("places"), "places").toArrow().combine_chunks()  # of a bounded sample
    places = placed["places"].combine_chunks()
    sample_bags = Bags(places.flatten().to_numpy(), pc.list_value_length(places).to_numpy())
    y = placed["toxic"].to_numpy().astype(float)
    picked = selected(sample_bags, y, alone, texts_of)
    return Machine(known[picked], *fit(sample_bags.only(picked, len(known)), y, len(picked)))


@lru_cache(maxsize=2)
def _worker_terms(terms: bytes) -> Terms:
    index = {int(h): i for i, h in enumerate(np.frombuffer(terms, np.int64))}
    return Terms(index.get)


def score(text: Column, machine: Machine) -> Column:
    """The probability that ``text`` is toxic."""
    raw = machine.terms.tobytes()

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        terms = _worker_terms(raw)
        logits = machine.logits([terms(t) for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(logits, -30, 30))))

    return toxic(text)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    machine = train(docs, labels, sample)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text"), machine).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more."""
    return docs.where(score(F.col("text"), train(docs, labels, sample)) < 0.5)
