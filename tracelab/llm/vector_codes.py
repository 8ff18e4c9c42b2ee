"""Vector code compression: product codes by a Lloyd iteration that compares active entries only.

Vectors become integers and are cut into consecutive parts, each with a codebook of its own.  A round assigns every part to its nearest entry and
moves each entry to the floored mean of its parts.  Distances are exact integers and kept with the parts, so a part whose entry stayed where
it was compares its stored distance with the entries that moved, and only the other parts look at the whole codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import named
from tracelab.session import materialise, scratch

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LIMIT = 2**28  # integers end here, so that distances stay below 2**63
ROWS = 4096  # vectors compared at a time


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, vector)``: rows whose vector has numbers only, each component ``floor(scale * x)`` and at most ``LIMIT`` in size."""
    whole = lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.least(F.lit(2.0**60), F.greatest(F.lit(-(2.0**60)), scale * x)))))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    values = F.transform(named(vector_col), lambda x: x.cast("double"))
    return vectors.select(named(id_col).cast("long").alias("vec_id"), named(label_col).alias("label"), values.alias("vector")).where(
        F.col("vector").isNotNull() & ~F.exists("vector", bad)
    ).withColumn("vector", F.transform("vector", lambda x: whole(x).cast("int")))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Integer vectors as rows; shorter ones end in zeros."""
    values, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries."""
    largest = max((int(np.abs(a).max(initial=0)) for a in (points, entries)), default=0)
    if 4 * largest * largest * max(points.shape[1], 1) < 2**53:  # every sum is an integer that a double holds
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)).astype(np.int64)
    out = np.zeros((len(points), len(entries)), np.int64)
    for column in range(points.shape[1]):
        out += (points[:, column, None] - entries[None, :, column]) ** 2
    return out


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower of equals, and its squared distance."""
    d = distances(points, entries)
    best = d.argmin(1)
    return best, d[np.arange(len(d)), best]


def reassigned(points: np.ndarray, entries: np.ndarray, moved: np.ndarray, held: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """New index and distance of each point that ``held`` an entry at distance ``error``, and how many points saw the whole codebook.

    No entry that stayed can have come nearer, so a point whose own entry stayed need only meet the ``moved`` ones; a moved entry wins
    if it is nearer, or as near with a lower index.
    """
    own = moved[held]
    held, error = held.copy(), error.copy()
    if own.any():
        held[own], error[own] = nearest(points[own], entries)
    active = np.nonzero(moved)[0]
    if len(active) and not own.all():
        at, d = nearest(points[~own], entries[active])
        at = active[at]
        old, was = held[~own], error[~own]
        won = (d < was) | ((d == was) & (at < old))
        held[~own], error[~own] = np.where(won, at, old), np.where(won, d, was)
    return held, error, int(own.sum())


STATE = "vec_id long, label {label}, vector array<int>, entries array<int>, errors array<long>, scans long"


def _assign(state: DataFrame, books: np.ndarray, moved: np.ndarray, label: str) -> DataFrame:
    """One assignment of all parts; ``books`` is (part, entry, position), ``moved`` (part, entry)."""
    parts, _, size = books.shape
    shared = state.sparkSession.sparkContext.broadcast((books, moved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, moves = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                rows = matrix(batch.column(2), parts * size)
                held, error = (c.flatten().to_numpy(zero_copy_only=False).reshape(-1, parts).astype(np.int64) for c in (batch.column(3), batch.column(4)))
                new, far, scans = np.zeros_like(held), np.zeros_like(error), np.zeros(len(rows), np.int64)
                for p in range(parts):
                    points = rows[:, p * size : (p + 1) * size]
                    scans += moves[p][held[:, p]]
                    new[:, p], far[:, p], _ = reassigned(points, book[p], moves[p], held[:, p], error[:, p])
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * parts)
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel(), k)) for v, k in ((new, pa.int32()), (far, pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), *lists, pa.array(scans)], ["vec_id", "label", "vector", "entries", "errors", "scans"]
                )

    return state.mapInArrow(run, STATE.format(label=label))


def _sums(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Component sums and counts of the parts of each entry, added up in the tasks first: at most one number for each of the codebooks' components."""
    parts, entries, size = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for batch in batches:
            rows = matrix(batch.column(0), parts * size)
            held = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
            for p in range(parts):
                np.add.at(sums[p], held[:, p], rows[:, p * size : (p + 1) * size])
                counts[p] += np.bincount(held[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.ListArray.from_arrays(ends, pa.array(sums[p, e].ravel()))],
            ["part", "entry", "n", "sums"],
        )

    added = state.select("vector", "entries").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = added.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)])
    sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
    for row in total.collect():  # a row per entry
        counts[row[0], row[1]], sums[row[0], row[1]] = row[2], row[3:]
    return sums, counts


@dataclass
class Codes:
    """``coded``: ``(vec_id, label, vector, entries, errors, scans)`` of every kept row; the codebooks; parts that saw a whole codebook in each assignment."""

    coded: DataFrame
    books: np.ndarray
    rescans: list[int]


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Codes:
    """Codebooks after ``rounds`` rounds, and every row's codes and distances under them.

    Rows whose vector is null or holds a null, NaN or infinite component are left out.  Vectors are cut into ``parts`` equal pieces; if lengths differ or do not
    divide, vectors count as filled with zeros up to the next length that does.  The first codebooks are the parts of the ``entries`` rows with the smallest ids
    (null ids last, equal ids by vector).  Ties go to the lower index; an entry without parts stays.  Repeated rows each count.
    Fewer rows than entries give as many entries; an empty table gives empty codebooks and no rows.  Extra columns are not carried.
    """
    kept = scratch(integers(vectors, id_col, vector_col, label_col, scale=scale), "integer-vectors")
    label = kept.df.schema["label"].dataType.simpleString()
    longest = kept.df.agg(F.max(F.size("vector"))).first()[0]
    none = lambda kind: F.array_repeat(F.lit(0), parts).cast(f"array<{kind}>")
    state_df = kept.df.withColumns({"entries": none("int"), "errors": none("bigint"), "scans": F.lit(0).cast("long")})
    if longest is None:
        return Codes(state_df, np.zeros((parts, 0, 0), np.int64), [])
    size = -(-longest // parts)
    first = kept.df.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    books = np.zeros((parts, len(first), size), np.int64)
    for e, (row,) in enumerate(first):
        filled = np.zeros(parts * size, np.int64)
        filled[: len(row)] = row
        books[:, e] = filled.reshape(parts, size)
    moved = np.ones(books.shape[:2], bool)
    state, rescans = kept, []
    for turn in range(rounds + 1):
        new = scratch(_assign(state_df, books, moved, label), "codes")
        state.drop()
        state, state_df = new, new.df
        rescans.append(state_df.agg(F.sum("scans")).first()[0])
        if turn == rounds:
            break
        sums, counts = _sums(state_df, books.shape)
        means = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        moved, books = (means != books).any(2), means
    return Codes(state_df, books, rescans)


def digest(books: np.ndarray) -> str:
    """Hash of all components in the order of part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_table(codes: Codes) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``: two hex digits per part, the distances' sum, and their sum over rows of equal label (nulls together)."""
    two = lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))
    rows = codes.coded.select(
        "vec_id", "label", F.array_join(F.transform("entries", two), "").alias("code"),
        F.aggregate("errors", F.lit(0).cast("long"), lambda t, x: t + x).alias("error"),
    )
    labels = materialise(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return rows.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(codes.books)).alias("codebooks_sha256")
    )
