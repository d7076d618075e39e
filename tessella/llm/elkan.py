"""Vector code compression: each quarter of a vector becomes the number of its nearest codebook entry.

Components become integers, ``floor(SCALE * x)``.  Each part position has a codebook of up to ``ENTRIES`` entries,
which Lloyd rounds improve.  Elkan's bounds make the rounds cheap: with each vector's part are kept an upper bound of the
distance to its entry and a lower bound of the distance to every entry.  After an update the bounds are shifted by
how far the entries moved.  An entry is passed over only where the triangle inequality proves it strictly farther:
its lower bound, or half its distance to the present entry, is above the upper bound.  All others are measured in
integers, so that ties are exact and go to the lower index.  Lower bounds are kept in a byte each, rounded down to a 255th
of the part's largest, upper bounds are rounded up: rounding can cost a measurement, never change a result.

Vectors stay where they are: a round is one pass over the rows with the codebooks (``ENTRIES`` rows, whatever the size
of the input), the new state is cut, and sums of entries are combined in executors before their at most
``PARTS * ENTRIES`` rows reach the driver.

Defined results: vectors that are null or hold null or non-finite components are dropped, as are those whose length
is not the most common one (of equally common ones the longest) or no multiple of ``PARTS``, and those with a scaled component of 2^28 or more in size, whose
distances might leave 64 bits.  Fewer kept rows than ``ENTRIES`` make that many entries.  Of the first entries, rows
with the same vec_id are ordered by their components; a null vec_id comes last.  Repeated rows each have a row of the
result.  Entries that no part uses stay.  An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Scaled components stay below this size.
LIMIT = 1 << 28
#: Vectors worked on at a time; bounds memory.
STEP = 512


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to the row of ``c`` beside it (integers)."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def up(squared: np.ndarray) -> np.ndarray:
    """Roots of integers, rounded up."""
    return np.nextafter(np.sqrt(squared.astype(np.float64)) * (1 + 1e-12), np.inf)


def down(squared: np.ndarray) -> np.ndarray:
    """Roots of integers, rounded down."""
    return np.maximum(np.nextafter(np.sqrt(squared.astype(np.float64)) * (1 - 1e-12), -np.inf), 0)


def all_squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries: by floats where those are exact, else by integers."""
    most = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 52:
        x, c = x.astype(np.float64), book.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([squares(x, np.broadcast_to(entry, x.shape)) for entry in book], 1)


class Part:
    """One part position's codebook, how far its entries moved, and the distances between them."""

    def __init__(self, book: np.ndarray, moved: np.ndarray | None = None):
        self.book, self.moved = book, moved
        self.half = down(all_squares(book, book)) / 2

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry, squared distance and lower bounds of each row, all measured."""
        d = all_squares(x, self.book)
        entry = d.argmin(1)
        return entry, d[np.arange(len(x)), entry], down(d)

    def next(self, x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the last round's entry and bounds, and the number of distances measured."""
        rows = np.arange(len(x))
        lower = np.maximum((lower - self.moved) * (1 - 1e-12), 0)
        upper = (upper + self.moved[entry]) * (1 + 1e-12)

        def open_():
            near = (lower <= upper[:, None]) & (self.half[entry] <= upper[:, None])
            near[rows, entry] = False
            return near

        loose = open_().any(1)
        best = squares(x, self.book[entry])
        upper[loose] = up(best[loose])
        i, c = np.nonzero(open_() & loose[:, None])
        d = squares(x[i], self.book[c])
        lower[i, c] = down(d)
        lower[rows, entry] = down(best)
        # the nearest of those measured and the present entry, ties to the lower index
        i, c, d = (np.concatenate(p) for p in ((i, rows), (c, entry), (d, best)))
        order = np.lexsort((c, d, i))
        leading = order[np.searchsorted(i[order], rows)]
        return c[leading], d[leading], lower, len(i)


def pack(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lower bounds (rows x entries) and each row's unit, rounded down."""
    unit = (lower.max(axis=1, initial=0) / 255).astype(np.float32)
    unit = np.where(unit.astype(np.float64) * 255 > lower.max(axis=1, initial=0), np.nextafter(unit, np.float32(0)), unit)
    held = np.floor(lower / np.maximum(unit, np.float32(1e-30)).astype(np.float64)[:, None] * (1 - 1e-12))
    return np.minimum(held, 255).astype(np.uint8), unit


def kept_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x (integers) of the rows that take part."""
    v = F.col("embedding")
    whole = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").alias("label"),
        F.transform(v, lambda e: e.cast("double")).alias("v"),
    ).where(v_ok("v"))
    sizes = whole.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    size = sizes[0]["n"] if sizes else 0
    if size == 0 or size % PARTS:
        return whole.where(F.lit(False)).select("vec_id", "label", F.col("v").cast("array<long>").alias("x"))
    scaled = F.transform("v", lambda e: F.floor(e * SCALE))
    return whole.where(F.size("v") == size).select("vec_id", "label", scaled.cast("array<long>").alias("x"))


def v_ok(name: str):
    """Whether an array of doubles has only finite components whose scaled size is below ``LIMIT``; null counts as no."""
    fine = F.forall(name, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LIMIT / SCALE - 1))
    return F.coalesce(fine, F.lit(False))


def _rows(column: pa.Array, n: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def assigner(books: list[np.ndarray], moved: list[np.ndarray] | None, last: bool):
    """A map over batches: rows get their entries by ``books``; with ``moved``, by their bounds; the ``last`` needs no bounds after it."""

    def run(batches):
        parts = [Part(b, moved[p] if moved else None) for p, b in enumerate(books)]
        width = books[0].shape[1]
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                n = batch.num_rows
                x = _rows(batch["x"], n, np.int32).astype(np.int64)
                held = [_rows(batch[c], n, k) for c, k in (("entry", np.uint8), ("upper", np.float64), ("unit", np.float32), ("lower", np.uint8))] if moved else None
                entries, uppers, units, lowers, error = [], [], [], [], np.zeros(n, np.int64)
                for p, part in enumerate(parts):
                    own = x[:, p * width : (p + 1) * width]
                    if held:
                        k = len(part.book)
                        lower = held[3][:, p * k : (p + 1) * k] * held[2][:, p, None].astype(np.float64)
                        entry, d, lower, _ = part.next(own, held[0][:, p].astype(np.int64), held[1][:, p], lower)
                    else:
                        entry, d, lower = part.first(own)
                    error += d
                    entries.append(entry)
                    if not last:
                        packed, unit = pack(lower)
                        uppers.append(up(d))
                        units.append(unit)
                        lowers.append(packed)
                none = pa.nulls(n, pa.binary())
                bounds = [none] * 3 if last else [_binary(np.stack(uppers, 1)), _binary(np.stack(units, 1)), _binary(np.concatenate(lowers, 1))]
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], batch["label"], batch["x"], _binary(np.stack(entries, 1).astype(np.uint8)), *bounds, pa.array(error)],
                    ["vec_id", "label", "x", "entry", "upper", "unit", "lower", "error"],
                )

    return run


def summer(width: int):
    """A map over batches: part, entry, sums of components and the count, for all that a task has."""

    def run(batches):
        sums = np.zeros((PARTS, ENTRIES, width), np.int64)
        counts = np.zeros((PARTS, ENTRIES), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, entry = _rows(batch["x"], n, np.int32).astype(np.int64), _rows(batch["entry"], n, np.uint8)
            for p in range(PARTS):
                np.add.at(sums[p], entry[:, p], x[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(entry[:, p], minlength=ENTRIES)
        p, e = np.nonzero(counts)
        part, entry, at = (np.repeat(v, width) for v in (p, e, np.zeros(len(p), int)))
        at = np.tile(np.arange(width), len(p))
        yield pa.RecordBatch.from_arrays(
            [pa.array(v.astype(np.int32)) for v in (part, entry, at)] + [pa.array(sums[p, e].ravel()), pa.array(np.repeat(counts[p, e], width))],
            ["part", "entry", "at", "total", "n"],
        )

    return run


def updated(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after an update: the componentwise floor of the mean of what each entry was given."""
    width = books[0].shape[1]
    rows = state.select("x", "entry").mapInArrow(summer(width), "part int, entry int, at int, total long, n long")
    means = rows.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    out = [b.copy() for b in books]
    part, entry, at, total, n = (means[c].to_numpy() for c in ("part", "entry", "at", "total", "n"))
    for p, e, k, value in zip(part.tolist(), entry.tolist(), at.tolist(), (total // n).tolist()):
        out[p][e, k] = value
    return out


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, entry (a byte a part), error) of each kept row, and the final codebooks."""
    spark = vectors.sparkSession
    kept = kept_rows(vectors)
    label = kept.schema["label"].dataType.simpleString()
    kept = cut(kept)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").toArrow()["x"].to_pylist()
    if not first:
        return spark.createDataFrame([], f"vec_id long, label {label}, entry binary, error long"), []
    start = np.array(first, np.int64)
    books = [np.ascontiguousarray(b) for b in np.split(start, PARTS, axis=1)]

    def packed(batches):
        for batch in batches:
            x = batch["x"].flatten().to_numpy().astype(np.int32).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], _binary(x)], ["vec_id", "label", "x"])

    state, moved = kept.mapInArrow(packed, f"vec_id long, label {label}, x binary"), None
    schema = f"vec_id long, label {label}, x binary, entry binary, upper binary, unit binary, lower binary, error long"
    for k in range(rounds + 1):
        state = cut(state.mapInArrow(assigner(books, moved, k == rounds), schema))
        if k < rounds:
            new = updated(state, books)
            moved = [up(squares(a, b)) for a, b in zip(books, new)]
            books = new
    return state.select("vec_id", "label", "entry", "error"), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' integers by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept row."""
    rows, books = compress(vectors, rounds)
    totals = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(totals, rows["label"].eqNullSafe(totals["of"])).select(
        "vec_id", F.lower(F.hex("entry")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def _sql() -> str:
    """DuckDB SQL: every round measures all entries."""
    table = "SELECT a.vec_id, a.label, a.rid, p.part, a.x[p.part * w + 1:(p.part + 1) * w] AS v FROM kept a, (SELECT unnest(range({parts})) AS part) p, (SELECT max(len(x)) // {parts} AS w FROM kept)"
    steps = [
        f"""raw AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)) AS f FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e::DOUBLE) OR abs(e::DOUBLE) >= {LIMIT / SCALE - 1})) = 0),
common AS (SELECT len(f) AS n FROM raw GROUP BY n ORDER BY count(*) DESC, n DESC LIMIT 1),
kept AS MATERIALIZED (
  SELECT rid, vec_id, label, list_transform(f, lambda e: e::BIGINT) AS x FROM raw WHERE len(f) = (SELECT n FROM common) AND len(f) > 0 AND len(f) % {PARTS} = 0),
piece AS MATERIALIZED ({table.format(parts=PARTS)}),
b0 AS MATERIALIZED (
  SELECT part, rank - 1 AS entry, v FROM (
    SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, x) AS rank FROM piece JOIN (SELECT rid, x FROM kept) USING (rid)) WHERE rank <= {ENTRIES})"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (
  SELECT rid, part, min({{'d': d, 'e': entry}}) AS best FROM (
    SELECT p.rid, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM piece p JOIN b{k} b USING (part)) GROUP BY rid, part)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""m{k} AS (
  SELECT part, entry, list(m ORDER BY place) AS v FROM (
    SELECT part, best.e AS entry, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m
    FROM (SELECT rid, part, unnest(v) AS x, unnest(range(len(v))) AS place FROM piece) JOIN a{k} USING (rid, part) GROUP BY ALL) GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f""",
coded AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""
    )


SQL = _sql()
