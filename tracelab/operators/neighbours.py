"""Exact nearest neighbours over pivot cells.

Every row belongs to the cell of its nearest pivot.  Distances to the pivots bound those to all rows of a cell (triangle inequality), and
a histogram of each cell's radii tells within which distance enough training rows must lie.  A row meets only cells that may
hold a nearer one; what is skipped cannot change the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.functions.hashing import draw
from tracelab.session import materialise

PIVOTS = 64
BINS = 16  # of a cell's radii
SLACK = 1e-9  # relative, for sums rounded in another order
STEP = 256  # rows compared at a time
BLOCK_BYTES = 2**27  # of a block's test rows and their nearest rows
OUT = 2**18  # rows of a batch of results
TILE = 2**16  # products of test and training rows at a time
PAIRS = 2**14  # distances that are summed at a time
MERGED = 2**20  # distances among which the nearest are chosen at a time
NOBODY = -(2**63)  # in place of a null id among training rows
FOUND = ["sample_id", "neighbour", "y", "distance"]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed from the differences themselves."""
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        out[i] = ((b - row) ** 2).sum(axis=1)
    return out


@dataclass
class Cells:
    """Pivots, and for each fold and cell the number of rows, their least and largest radius and the histogram of radii below the largest."""

    pivots: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    bins: np.ndarray

    def others(self, fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(count, low, high, bins)`` of each cell over all folds but one."""
        rest = np.arange(len(self.counts)) != fold
        some = np.where(self.counts[rest] > 0, 1, np.nan)
        with np.errstate(all="ignore"):
            low = np.nan_to_num(np.fmin.reduce(self.low[rest] * some, axis=0, initial=np.nan), nan=np.inf)
            high = np.nan_to_num(np.fmax.reduce(self.high[rest] * some, axis=0, initial=np.nan), nan=-np.inf)
        return self.counts[rest].sum(0), low, high, self.bins[rest].sum(0)

    def needed(self, distance: np.ndarray, fold: int, k: int) -> np.ndarray:
        """Which cells may hold one of the ``k`` nearest rows of other folds, from a row's distances to the pivots."""
        count, low, high, bins = self.others(fold)
        width = self.high.max(axis=0)
        edge = width[:, None] * (np.arange(1, BINS + 1) / BINS)
        out = np.zeros(distance.shape, bool)
        for i, d in enumerate(distance):
            reach = (d[:, None] + edge).ravel()
            order = np.argsort(reach, kind="stable")
            enough = np.searchsorted(np.cumsum(bins.ravel()[order]), min(k, int(count.sum())))
            bound = reach[order[min(enough, len(order) - 1)]] * (1 + SLACK) + SLACK
            out[i] = (count > 0) & (np.maximum(d - high, low - d) <= bound)
        return out


def cells(df: DataFrame, *, pivots: int = PIVOTS, seed: int = 0) -> tuple[DataFrame, Cells]:
    """``(sample_id, y, fold, features, cell, radius)`` of every row, and the cells' bounds.

    ``pivots`` rows are drawn; with the folds and ``BINS`` their number bounds all that the driver and the tasks get to hold.
    """
    drawn = df.select(draw(seed, "sample_id").alias("d"), "sample_id", "features").orderBy("d", "sample_id").limit(pivots)
    points = np.array([r[2] for r in drawn.collect()], dtype=np.float64)
    if not len(points):
        return df.select("sample_id", "y", "fold", "features", F.lit(0).alias("cell"), F.lit(0.0).alias("radius")), Cells(
            points, *[np.zeros((1, 1))] * 3, np.zeros((1, 1, BINS))
        )
    held = df.sparkSession.sparkContext.broadcast(points)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                d = _apart(_matrix(part.column(3)), held.value)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell, pa.int32()), pa.array(np.sqrt(d[np.arange(len(d)), cell]))],
                    ["sample_id", "y", "fold", "features", "cell", "radius"],
                )

    plain = df.select(F.col("sample_id").cast("long"), F.col("y").cast("int"), F.col("fold").cast("int"), F.col("features").cast("array<double>"))
    placed = materialise(plain.mapInArrow(place, "sample_id long, y int, fold int, features array<double>, cell int, radius double"), "cells")
    spans = placed.groupBy("fold", "cell").agg(F.count("*"), F.min("radius"), F.max("radius")).collect()
    folds = max(r[0] for r in spans) + 1
    counts, low, high = (np.zeros((folds, len(points))) for _ in range(3))
    for fold, cell, n, a, b in spans:
        counts[fold, cell], low[fold, cell], high[fold, cell] = n, a, b
    width = F.array(*[F.lit(float(w)) for w in high.max(axis=0)])
    share = F.col("radius") / F.nullif(F.get(width, F.col("cell")), F.lit(0.0))
    at = F.least(F.lit(BINS - 1), F.coalesce(F.floor(share * BINS), F.lit(0)))
    bins = np.zeros((folds, len(points), BINS))
    for fold, cell, b, n in placed.groupBy("fold", "cell", at.alias("bin")).agg(F.count("*")).collect():
        bins[fold, cell, b] = n
    # a bin's rows lie within its upper edge; one that rounding put into the bin below is covered by the slack
    return placed, Cells(points, counts, low, high, bins)


def routed(placed: DataFrame, known: Cells, k: int | None) -> DataFrame:
    """``(sample_id, fold, features, k, cells)``: the cells that each row has to meet; without ``k`` it is the root of the number of its training rows."""
    held = placed.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                distance = np.sqrt(_apart(_matrix(part.column(2)), cell.pivots))
                fold = part.column(1).to_numpy()
                wanted, met = np.zeros(len(fold), np.int64), [np.zeros(0, np.int32)] * len(fold)
                for f in np.unique(fold):
                    at = np.nonzero(fold == f)[0]
                    near = k if k is not None else int(np.sqrt(cell.others(f)[0].sum()))
                    wanted[at] = near
                    for i, row in zip(at, cell.needed(distance[at], f, near), strict=True):
                        met[i] = np.nonzero(row)[0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(wanted), pa.array(met, pa.list_(pa.int32()))], ["sample_id", "fold", "features", "k", "cells"])

    return placed.select("sample_id", "fold", "features").mapInArrow(run, "sample_id long, fold int, features array<double>, k long, cells array<int>")


def routes(placed: DataFrame, known: Cells, k: int | None) -> DataFrame:
    """``(sample_id, fold, features, k, cell)``: a row for each cell that a row has to meet."""
    return routed(placed, known, k).select("sample_id", "fold", "features", "k", F.explode("cells").alias("cell"))


@dataclass
class Held:
    """A block's test rows while training rows pass by, and for each the ``n`` nearest found so far, at most ``k``: distances, ids and classes (NaN for null)."""

    ids: np.ndarray
    fold: np.ndarray
    k: np.ndarray
    rows: np.ndarray
    met: list[np.ndarray]  # rows that have to meet a cell, by cell
    n: np.ndarray
    distance: np.ndarray
    neighbour: np.ndarray
    y: np.ndarray
    last: np.ndarray  # beyond this distance a row has no use for others
    waiting: list[tuple[np.ndarray, ...]]  # row, distance, id and class of rows that are near enough and not yet among the nearest
    count: int = 0  # of them

    @staticmethod
    def of(table: pa.Table) -> Held:
        column = lambda name: table.column(name).combine_chunks()
        k, cells = column("k").to_numpy(), column("cells")
        row = np.repeat(np.arange(len(k)), np.diff(cells.offsets.to_numpy()))
        cell = cells.flatten().to_numpy()
        order = np.argsort(cell, kind="stable")
        met = np.split(row[order], np.cumsum(np.bincount(cell))[:-1]) if len(cell) else []
        empty = (len(k), int(k.max(initial=0)))
        return Held(
            column("sample_id").to_numpy(), column("fold").to_numpy(), k, _matrix(column("features")), met,
            np.zeros(len(k), np.int64), np.zeros(empty), np.zeros(empty, np.int64), np.zeros(empty), np.full(len(k), np.inf), [],
        )

    def meet(self, cell: int, ids: np.ndarray, y: np.ndarray, folds: np.ndarray, rows: np.ndarray) -> None:
        """Training rows of one cell pass by.  A matrix product tells which may be near enough; distances are then summed from the differences."""
        if cell >= len(self.met) or not self.distance.shape[1]:
            return
        met = self.met[cell][self.k[self.met[cell]] > 0]
        for fold in np.unique(self.fold[met]):
            mine, others = met[self.fold[met] == fold], np.nonzero(folds != fold)[0]
            train = rows[others]
            with np.errstate(all="ignore"):
                size, turned = (train**2).sum(1) * (1 - SLACK), -2 * train.T
            tile = max(16, TILE // max(1, len(train)))
            for start in range(0, len(mine), tile):
                at = mine[start : start + tile]
                own = self.rows[at]
                with np.errstate(all="ignore"):
                    product = own @ turned
                    product += size
                    far = product > (self.last[at] * (1 + SLACK) + SLACK - (own**2).sum(1) * (1 - SLACK))[:, None]
                i, near = np.nonzero(~far)
                if not len(i):
                    continue
                d = np.empty(len(i))
                for a in range(0, len(i), PAIRS):
                    d[a : a + PAIRS] = ((train[near[a : a + PAIRS]] - own[i[a : a + PAIRS]]) ** 2).sum(axis=1)
                self.waiting.append((at[i], d, ids[others[near]], y[others[near]]))
                self.count += len(i)
                if self.count >= max(PAIRS, self.distance.size // 2):
                    self.settle()
        if self.count >= PAIRS and (self.n < self.k).any():
            self.settle()

    def settle(self) -> None:
        """The waiting rows are put among the nearest."""
        if not self.waiting:
            return
        row, d, names, kinds = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        self.waiting, self.count = [], 0
        order = np.argsort(row, kind="stable")
        row, d, names, kinds = row[order], d[order], names[order], kinds[order]
        rows, begin, count = np.unique(row, return_index=True, return_counts=True)
        for k in np.unique(self.k[rows]):
            some = np.nonzero(self.k[rows] == k)[0]
            some = some[np.argsort(count[some], kind="stable")]  # rows of like width together
            at = 0
            while at < len(some):
                wide = np.nonzero((k + count[some[at:]]) * np.arange(1, len(some) - at + 1) > MERGED)[0]
                part = some[at : at + max(1, int(wide[0]) if len(wide) else len(some))]
                at += len(part)
                self._merge(int(k), rows[part], begin[part], count[part], d, names, kinds)

    def _merge(self, k: int, r: np.ndarray, begin: np.ndarray, count: np.ndarray, d: np.ndarray, names: np.ndarray, kinds: np.ndarray) -> None:
        """Of some rows the ``k`` nearest of what they have and of the ``count`` rows from ``begin`` on."""
        line = np.repeat(np.arange(len(r)), count)
        slot = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
        new = np.repeat(begin, count) + slot
        held = np.arange(k) < self.n[r][:, None]
        shape = (len(r), k + int(count.max()))
        real, every, ids, y = np.zeros(shape, bool), np.full(shape, np.inf), np.zeros(shape, np.int64), np.zeros(shape)
        real[:, :k], every[:, :k], ids[:, :k], y[:, :k] = held, np.where(held, self.distance[r, :k], np.inf), self.neighbour[r, :k], self.y[r, :k]
        real[line, k + slot], every[line, k + slot], ids[line, k + slot], y[line, k + slot] = True, d[new], names[new], kinds[new]
        best = np.argpartition(every, k - 1, axis=1)[:, :k]
        edge = np.take_along_axis(every, best, 1).max(1)
        n = np.minimum(k, self.n[r] + count)
        # ties at the edge go to the smaller id, and rows that have fewer than k, or distances that are no numbers, keep what they have
        for i in np.nonzero((n < k) | ((every <= edge[:, None]).sum(1) != k) | ~np.isfinite(edge) | (real & ~np.isfinite(every)).any(1))[0]:
            own = np.nonzero(real[i])[0]
            own = own[np.lexsort((ids[i, own], every[i, own]))][:k]
            best[i, : len(own)] = own
        self.distance[r, :k], self.neighbour[r, :k], self.y[r, :k] = (np.take_along_axis(x, best, 1) for x in (every, ids, y))
        self.n[r] = n
        self.last[r] = np.where(n < k, np.inf, self.distance[r, :k].max(1))

    def found(self) -> Iterator[pa.RecordBatch]:
        """Rows of one id share their neighbours, as many of the nearest as each number of them asks for."""
        self.settle()
        order = np.argsort(self.ids, kind="stable")
        edges = np.concatenate([[0], np.nonzero(np.diff(self.ids[order]))[0] + 1, [len(order)]]).astype(int)
        parts: list[tuple] = []
        waiting = 0
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at = order[a:b]
            used = np.arange(self.distance.shape[1]) < self.n[at][:, None]
            d, names, kinds = self.distance[at][used], self.neighbour[at][used], self.y[at][used]
            best = np.lexsort((names, d))
            for k in np.unique(self.k[at]):
                some = best[:k]
                parts.append((np.full(len(some), self.ids[at[0]]), names[some], kinds[some], d[some]))
                waiting += len(some)
            if waiting >= OUT or b == len(order):
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                names = pa.array(columns[1], pa.int64(), mask=columns[1] == NOBODY)
                kinds = pa.array(columns[2], pa.float64(), from_pandas=True).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), names, kinds, pa.array(columns[3])], FOUND)
                parts, waiting = [], 0


def nearest(df: DataFrame, k: int | None, *, pivots: int = PIVOTS, block_rows: int = 4096, seed: int = 0) -> DataFrame:
    """``(sample_id, neighbour, y, distance)``: for every row the ``k`` nearest rows of other folds, ties to the smaller id.

    ``df``: ``(sample_id, y, fold, features)`` with folds from 0 and features of one length.  Without ``k`` it is the floored root of the number of training rows.
    Test rows are cut by draw into blocks of bounded bytes, which hold their nearest rows so far; the training rows of the cells that a block needs pass by it
    sorted by cell, ``block_rows`` at a time.  What is shuffled is each training row once per block and the result; no candidates are.  An empty table, or
    one of a single fold, gives an empty result.
    """
    placed, known = cells(df, pivots=pivots, seed=seed)
    if not len(known.pivots):
        return placed.select("sample_id", F.lit(0).cast("long").alias("neighbour"), "y", F.lit(0.0).alias("distance")).limit(0)
    rows, folds = int(known.counts.sum()), range(len(known.counts))
    most = k if k is not None else max(int(np.sqrt(known.others(f)[0].sum())) for f in folds)
    wide = 8 * known.pivots.shape[1] + 24 * most + 4 * len(known.pivots)
    spread = 2 * df.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-rows * wide // BLOCK_BYTES), min(spread, rows // 256))
    sent = routed(placed.where(F.col("sample_id").isNotNull()), known, k)
    own = F.pmod(draw(f"{seed}-block", "sample_id"), F.lit(blocks)).cast("int")
    test = sent.select(own.alias("block"), F.lit(-1).alias("cell"), "sample_id", "fold", "features", F.lit(None).cast("int").alias("y"), "k", "cells")
    nobody = (F.lit(None).cast("long").alias("k"), F.lit(None).cast("array<int>").alias("cells"))
    train = placed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "cell", "sample_id", "fold", "features", "y", *nobody)
    together = test.unionByName(train).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, held = None, [], None
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.int64) * 2**20 + batch.column(1).to_numpy()
            edges = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]]).astype(int)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                at, cell = part.column(0)[0].as_py(), part.column(1)[0].as_py()
                if at != block:
                    if held is not None:
                        yield from held.found()
                    block, waiting, held = at, [], None
                if cell < 0:
                    waiting.append(part)
                    continue
                if waiting:
                    held, waiting = Held.of(pa.Table.from_batches(waiting)), []
                if held is not None:
                    for start in range(0, b - a, block_rows):
                        some = part.slice(start, block_rows)
                        y = some.column(5).cast(pa.float64()).to_numpy(zero_copy_only=False)
                        held.meet(cell, some.column(2).fill_null(NOBODY).to_numpy(), y, some.column(3).to_numpy(), _matrix(some.column(4)))
        if held is not None:
            yield from held.found()

    return together.mapInArrow(run, "sample_id long, neighbour long, y int, distance double")


def vote(near: DataFrame) -> DataFrame:
    """``(sample_id, y_pred, prob)``: the share of positive neighbours, and whether it is over a half."""
    return near.groupBy("sample_id").agg((F.avg("y") > 0.5).cast("int").alias("y_pred"), F.avg("y").alias("prob"))
