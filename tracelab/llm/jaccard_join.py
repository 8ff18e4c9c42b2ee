"""N-gram Jaccard join with a count-vector R-tree.

Shingles are hashed into groups.  Two sets whose similarity reaches the threshold differ in so few shingles that, cut into one group more
than that, they agree on a whole group; sets are gathered by the content of such groups.  There are some groups more, so that similar sets agree on several, and
each set passes over as many of its most common ones: what many sets have in part gathers none of them.  In a gathering, sets are points of
group counts: leaves of points with their bounding boxes make its R-tree, summed coordinate minima bound the overlap with a box and then with a point,
and the pairs that survive are verified on the sets themselves.

Shingles that no other set has are in no overlap, so a set shares at most its other ones: this bounds pairs further, and drops sets whose own
shingles alone keep them from the threshold.

A gathering's pairs are not all compared.  Sets of one text are one point; a few points of each gathering (its centres, those that share most groups
first) meet the others, links join components, and only pairs across components go on to the next round with ``GROWTH`` times as many centres.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.llm.common import block_probes, count_filters, each_batch, filter_bits, hash_filter, identified, mixed, passing, repeated_filter, words
from tracelab.session import Scratch, materialise, scratch

SHINGLE = 3
PERCENT = 90
GROUPS = 32  # coordinates of a point
LEAF = 64  # points of a leaf
BLOCK = 16_384  # rows of a gathering that pass its centres in one task
STEP = 1024  # of them that are compared at a time
GROWTH = 16  # each round takes so many times the centres of the one before
NARROW = 0.7  # smallest size over largest in one size class
COMMON = (2, 4, 16, 64, 256)  # by how many sets have a key it is told how common it is
WIDE = 32_767  # larger counts do not fit a point, and sets of more elements are not bounded by theirs


def shingles(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text, sorted distinct hashes of all runs of ``size`` words; a shorter text is one run, a text without words has none."""
    each = words(texts)
    everything = np.concatenate([np.zeros(0, np.uint64), *each])

    def runs(row: np.ndarray, width: int) -> np.ndarray:
        total = np.full(max(len(row) - width + 1, 0), width, np.uint64)
        for k in range(width):
            total = mixed(total * np.uint64(0x2545F4914F6CDD1D) + row[k : k + len(total)])
        return total

    whole = runs(everything, size)
    out, at = [], 0
    for row in each:
        n = len(row)
        out.append(np.unique(whole[at : at + n - size + 1]) if n >= size else runs(row, n) if n else row)
        at += n
    return out


def largest_difference(total: int, percent: int) -> int:
    """How many elements may be in one of two sets only, if together they count ``total`` and are similar enough."""
    return total * (100 - percent) // (100 + percent)


def size_class(n: int, percent: int) -> list[tuple[int, int]]:
    """``(class, largest size)`` of the classes in which a set of ``n`` meets its partners: its own, and the next if they may be larger."""
    c, high = 0, 1
    while high < n:
        c, high = c + 1, max(high + 1, int(high / NARROW))
    out = [(c, high)]
    if n * 100 // percent > high:
        out.append((c + 1, max(high + 1, int(high / NARROW))))
    return out


def group_keys(hashes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each size class of a set the keys of its groups, how many elements each group has, and how many keys the set may pass over.

    With ``d`` differing elements at most, a cut into ``d + 1 + 2 s`` groups leaves ``1 + 2 s`` equal groups at least.  If both sets order their groups by
    the same measure of the keys, the first group that they share has ``2 s`` shared ones behind it, so each set may pass over its ``2 s`` last ones.
    """
    for c, high in size_class(len(hashes), percent) if len(hashes) else ():
        d = largest_difference(2 * high, percent)
        if not d:
            continue  # only equal sets are similar enough
        spare = (d + 1) // 4
        parts = d + 1 + 2 * spare
        spread = mixed(hashes ^ mixed(np.array([c + 1], np.uint64)))
        group = (spread >> np.uint64(33)) % np.uint64(parts)
        group = group.view(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, group, spread)
        own = mixed(sums + mixed(np.arange(parts, dtype=np.uint64) * np.uint64(1009) + np.uint64(c)))
        yield own, np.bincount(group, minlength=parts), 2 * spare


def gathering_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """All keys of a set."""
    return np.concatenate([np.zeros(0, np.uint64), *(own for own, _, _ in group_keys(hashes, percent))])


def rarest_keys(sets: list[np.ndarray], percent: int, level: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """For each set keys under which it meets every other set of at least that similarity but its equals, unless no other set has them.

    ``level`` tells how common keys are, 0 for those that no other set has.  The most common ones are passed over; what an empty group says is least.
    """
    found = [[*group_keys(s, percent)] for s in sets]
    none = np.zeros(0, np.uint64)
    levels = level(np.concatenate([none, *(own for of in found for own, _, _ in of)]))
    out, at = [], 0
    for of in found:
        keys = [none]
        for own, counts, over in of:
            rank = np.where(counts > 0, levels[at : at + len(own)], len(COMMON) + 1)
            at += len(own)
            shared = np.nonzero(rank)[0]  # all others come before these
            if len(shared) > over:
                order = np.lexsort((own[shared], rank[shared]))
                keys.append(own[shared[order[: len(shared) - over]]])
        out.append(np.unique(np.concatenate(keys)))
    return out


def point(hashes: np.ndarray) -> np.ndarray:
    """Counts of a set's elements by group."""
    return np.bincount((hashes & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)


def signature(hashes: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _signed(base: DataFrame, size: int) -> DataFrame:
    """``(id, fp, n, s1, s2)``: size and signature of every row's set."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingles(batch.column(2).to_pylist(), size)
        marks = [signature(s) for s in sets]
        columns = [[len(s) for s in sets], [m[0] for m in marks], [m[1] for m in marks]]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], ["id", "fp", "n", "s1", "s2"])

    return base.mapInArrow(each_batch(read), "id long, fp long, n long, s1 long, s2 long")


def _standing(base: DataFrame, signed: DataFrame) -> DataFrame:
    """Rows that stand for the others of their set, which need no keys of their own; the filter may let others through."""
    one = signed.where("n > 0").groupBy("s1").agg(F.min(F.struct("id", "fp")).alias("one"))
    mark = lambda i, fp: F.xxhash64(i, fp).alias("mark")
    ones = hash_filter(one.select(mark("one.id", "one.fp")), "mark")
    return _held(base.select("id", "fp", "text", mark("id", "fp")), "mark", ones).drop("mark")


def _held(rows: DataFrame, col: str, bits: np.ndarray, held: bool = True) -> DataFrame:
    """Rows whose hash the filter holds, or those whose it does not hold."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    at = rows.columns.index(col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passing(batch.column(at).to_numpy().view(np.uint64), shared.value) == held))

    return rows.mapInArrow(keep, rows.schema)


def _key_filters(base: DataFrame, size: int, percent: int, bits: int) -> list[np.ndarray]:
    """The filters of keys that several rows have, by how many."""

    def read(batch: pa.RecordBatch) -> np.ndarray:
        sets = shingles(batch.column(0).to_pylist(), size)
        return np.concatenate([np.zeros(0, np.uint64), *(np.unique(own[counts > 0]) for s in sets for own, counts, _ in group_keys(s, percent))])

    return count_filters(base.select("text"), read, COMMON, bits)


def key_level(keys: np.ndarray, filters: list[np.ndarray]) -> np.ndarray:
    """By how many filters, from the first on, each key passes: the same number wherever a key is met."""
    out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for bits in filters:
        left = left[passing(keys[left], bits, block_probes)]
        if not len(left):
            break
        out[left] += 1
    return out


def _members(base: DataFrame, filters: list[np.ndarray], size: int, percent: int) -> DataFrame:
    """``(id, fp, node, n, keys, point, hashes)`` of rows with keys that the first filter passes, after the most common ones are passed over."""
    shared = base.sparkSession.sparkContext.broadcast(filters)
    names = ["id", "fp", "node", "n", "keys", "point", "hashes"]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.int16()), pa.list_(pa.int64())]

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in names]
        ids, fps, texts = (c.to_pylist() for c in batch.columns)
        sets = shingles(texts, size)
        for i, fp, s, k in zip(ids, fps, sets, rarest_keys(sets, percent, lambda keys: key_level(keys, shared.value)), strict=True):
            if len(k):
                for col, v in zip(rows, (i, fp, signature(s)[0], len(s), k.view(np.int64), np.minimum(point(s), WIDE).astype(np.int16), s.view(np.int64)), strict=True):
                    col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

    return base.select("id", "fp", "text").mapInArrow(
        each_batch(read, 64), "id long, fp long, node long, n long, keys array<long>, point array<short>, hashes array<long>"
    )


def _once(members: DataFrame) -> DataFrame:
    """One row of each set: only sets that may be there twice (a row repeated, or let through beside the one that stands for it) are shuffled."""
    several = members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    maybe = hash_filter(several, "node")
    again = materialise(_held(members, "node", maybe).dropDuplicates(["node"]), "sets-once")
    return _held(members, "node", maybe, held=False).unionByName(again)


def _supported(sets: DataFrame, bits: int) -> DataFrame:
    """``(node, n, keys, point, m)``, ``m``: how many of a set's elements other sets may have too.  The filter may count more, never fewer, so that it bounds at any size."""

    def read(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)

    shared = sets.sparkSession.sparkContext.broadcast(repeated_filter(sets.select("hashes"), read, bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(4)
            hit = passing(column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), shared.value, block_probes)
            before = np.concatenate([[0], np.cumsum(hit)])
            ends = column.offsets.to_numpy() - column.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(before[ends[1:]] - before[ends[:-1]], pa.int64())], [*batch.schema.names[:4], "m"])

    return sets.select("node", "n", "keys", "point", "hashes").mapInArrow(count, "node long, n long, keys array<long>, point array<short>, m long")


def minima(a: Column, b: Column) -> Column:
    """Summed coordinate minima: no two sets with these counts share more."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)


def _among(sets: DataFrame, nodes: DataFrame, col: str) -> DataFrame:
    """``(node, hashes)`` of the sets that a column names, and of others that the filter lets through: only these are shuffled."""
    return _held(sets.select("node", "hashes"), "node", hash_filter(nodes, col))


def most_shared(a: Column, b: Column, counts: Column) -> Column:
    """The most that two sets can share: no more than either has in common with any, nor, if their counts are whole, than the summed minima."""
    least = F.least(a["m"], b["m"])
    return F.when(F.greatest(a["n"], b["n"]) > WIDE, least).otherwise(F.least(least, counts))


def enough(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of ``n`` and ``m`` elements that share so many are similar enough."""
    return 100 * shared >= percent * (n + m - shared)


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(node, comp)``: the smallest node that each node of the edges ``(a, b)`` reaches.

    Labels fall to the least one among neighbours, then to that label's own; a pass that changes nothing ends it.  ``known`` may hold components
    of some of the edges, to start from.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp"))
    if known is not None:
        labels = labels.join(known.withColumnRenamed("comp", "had"), "node", "left").select("node", F.least("comp", "had").alias("comp"))
    table = scratch(labels, "labels")
    while True:
        labels = table.df.select("node", "comp")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        low = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "near").alias("low"))
        jump = low.join(labels.select(F.col("node").alias("low"), F.col("comp").alias("jump")), "low")
        moved = scratch(jump.select("node", F.col("comp").alias("was"), F.least("low", "jump").alias("comp")), "labels")
        table.drop()
        table = moved
        if moved.df.where("comp < was").isEmpty():
            return moved.df.select("node", "comp")


def _near_centres(ranked: DataFrame, take: int, percent: int) -> DataFrame:
    """``(a, b)``: pairs of a gathering's first ``take`` rows, its centres, and later rows of other components that their points leave near enough.

    The centres of a gathering are leaves of ``LEAF`` points, each with its box.  Rows pass by in blocks of ``BLOCK`` at most, each of which has all centres
    of its gathering.
    """
    columns = ["key", "block", "r", "node", "comp", "n", "m", "point"]
    large = ranked.where(F.col("r") > BLOCK).groupBy("key").agg(F.ceil(F.max("r") / BLOCK).cast("int").alias("blocks"))
    large = materialise(large, "large-gatherings")
    rows = ranked.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    centres = rows.where(F.col("r") <= take).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = rows.where("r > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    kinds = centres.select(F.lit(0).alias("kind"), *columns).unionByName(every.select(F.lit(1).alias("kind"), *columns))
    met = kinds.repartition("key", "block").sortWithinPartitions("key", "block", "kind", "r")

    def near(centre: list[np.ndarray], boxes: np.ndarray, row: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        r, node, comp, n, m, at = row
        cr, cnode, ccomp, cn, cm, cat = centre
        for leaf, box in enumerate(boxes):
            own = slice(leaf * LEAF, (leaf + 1) * LEAF)
            widest, largest, least = cm[own].max(), cn[own].max(), cn[own].min()
            shared = np.minimum(m, widest)
            counted = np.maximum(n, largest) <= WIDE
            shared = np.where(counted, np.minimum(shared, np.minimum(at, box).sum(1)), shared)
            some = np.nonzero((100 * shared >= percent * (n + least - shared)) & (r > cr[own][0]))[0]
            if not len(some):
                continue
            if len(some) * len(cr[own]) <= LEAF:
                total = np.minimum(at[some, None], cat[own]).sum(2)
            else:
                total = np.zeros((len(some), len(cr[own])), np.int64)
                for g in range(GROUPS):
                    total += np.minimum(at[some, g, None], cat[own, g])
            shared = np.minimum(m[some, None], cm[own])
            counted = np.maximum(n[some, None], cn[own]) <= WIDE
            shared = np.where(counted, np.minimum(shared, total), shared)
            close = 100 * shared >= percent * (n[some, None] + cn[own] - shared)
            i, k = np.nonzero(close & (cr[own] < r[some, None]) & (ccomp[own] != comp[some, None]))
            yield cnode[own][k], node[some[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, centre, boxes = None, [], [], np.zeros((0, GROUPS))
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                keys, blocks, kinds = (part.column(k).to_numpy() for k in (1, 2, 0))
                edges = np.nonzero((np.diff(keys) != 0) | (np.diff(blocks) != 0) | (np.diff(kinds) != 0))[0] + 1
                values = [part.column(k).to_numpy() for k in range(3, 8)] + [part.column(8).flatten().to_numpy().reshape(-1, GROUPS).astype(np.int32)]
                pairs = []
                for a, b in zip([0, *edges], [*edges, len(keys)], strict=True):
                    if now != (keys[a], blocks[a]):
                        now, waiting, centre = (keys[a], blocks[a]), [], []
                    some = [v[a:b] for v in values]
                    if kinds[a] == 0:
                        waiting.append(some)
                        continue
                    if waiting:
                        centre, waiting = [np.concatenate(c) for c in zip(*waiting, strict=True)], []
                        boxes = np.maximum.reduceat(centre[-1], np.arange(0, len(centre[0]), LEAF), axis=0)
                    pairs += near(centre, boxes, some)
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*pairs, strict=True)], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _linked(sets: DataFrame, elements: DataFrame, percent: int) -> tuple[DataFrame, DataFrame] | None:
    """``(a, b)``: links that join all sets which chains of similar pairs connect, and ``(node, comp)``, their components; None where there are no links.

    ``elements`` has the sets themselves.  Centres are taken in the order of ``o``: sets that share most groups first, which are nearest to whatever the others were copied from.
    """

    def open_rows(rows: DataFrame) -> DataFrame:
        """Rows of gatherings that hold sets of more than one component."""
        opened = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
        return rows.join(opened, "key")

    def ranked(rows: DataFrame) -> Scratch:
        return scratch(rows.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("o"))), "live")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those pairs ``(a, b)`` of nodes that are similar enough: by their bounds first, then by the sets themselves."""
        bounds = lambda c: sets.select(F.col("node").alias(c), F.struct("n", "m", "point").alias(f"of_{c}"))
        of = F.col("of_a"), F.col("of_b")
        may = enough(most_shared(*of, minima(F.col("of_a.point"), F.col("of_b.point"))), F.col("of_a.n"), F.col("of_b.n"), percent)
        left = materialise(pairs.join(bounds("a"), "a").join(bounds("b"), "b").where(may).select("a", "b"), "pairs")
        own = lambda c: _among(elements, left.select(c).distinct(), c).select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}"))
        shared = F.size(F.array_intersect("ha", "hb"))
        return left.join(own("a"), "a").join(own("b"), "b").where(enough(shared, F.size("ha"), F.size("hb"), percent)).select("a", "b")

    def relabelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
        if comps is None:
            return rows
        return rows.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    # first all sets meet one centre of each gathering, as pairs of node numbers: a gathering's centre is nearly always the same set
    able = sets.where(100 * F.col("m") >= percent * F.col("n"))
    rows = scratch(able.select("node", (-F.size("keys")).alias("d"), F.col("node").alias("comp"), F.explode("keys").alias("key")), "gathered")
    centres = rows.df.groupBy("key").agg(F.min(F.struct("d", "node")).alias("c"), F.count("*").alias("size")).where("size > 1").select("key", F.col("c.node").alias("a"))
    centres = scratch(centres, "centres")
    met = rows.df.join(centres.df, "key").where(F.col("node") != F.col("a"))
    links = materialise(verified(met.select("a", F.col("node").alias("b")).distinct()), "links")
    found: DataFrame | None = None
    comps: DataFrame | None = None
    if not links.isEmpty():
        found, comps = links, components(links)
    # then, in gatherings that still hold several components, centres in leaves
    rest = scratch(open_rows(relabelled(met.drop("a"), comps)), "unsettled")
    with_points = rest.df.join(sets.select("node", "n", "m", "point"), "node").withColumn("o", F.struct("d", "node")).drop("d")
    live = ranked(with_points)
    rows.drop()
    centres.drop()
    rest.drop()
    take = GROWTH
    while not live.df.isEmpty():
        pairs = _near_centres(live.df, take, percent).distinct()
        links = materialise(verified(pairs), "links")
        if not links.isEmpty():
            found = links if found is None else found.unionByName(links)
            comps = components(found, comps)
        last, live = live, ranked(open_rows(relabelled(live.df.where(F.col("r") > take).drop("r"), comps)))
        last.drop()
        take *= GROWTH
    return None if found is None else (found, comps)


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """Sets of all rows, the links between different sets and their components.

    First ``(id, fp, n, s1, s2)``: rows with equal signatures are one class.  Then ``(a, b)``, by the ``s1`` of two classes: each link is a verified pair,
    and together they connect whatever the full join connects; with them ``(node, comp)``, the least ``s1`` that each of these reaches.  None if there are no links.
    """
    base = identified(docs, id_col, text_col).select("id", "fp", "text")
    signed = materialise(_signed(base, size), "signatures")
    ones = _standing(base, signed)
    bits = filter_bits(signed.agg(F.sum("n")).first()[0] or 0)
    members = materialise(_members(ones, _key_filters(ones, size, percent, bits), size, percent), "members")
    sets = _once(members)
    bits = filter_bits(members.agg(F.sum("n")).first()[0] or 0)
    return signed, _linked(materialise(_supported(sets, bits), "sets"), sets, percent)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(id, fp, n_shingles, class_id, component_id)``: one row per input row.

    A text's set holds its distinct runs of ``size`` words (A-Z lower-cased); fewer words are one run; a text without words, or null, has an empty set and
    no links.  Two rows are linked if ``100 * shared >= percent * union``, tested on 64-bit hashes; equal sets are linked.  ``class_id`` is the smallest id among
    rows of equal set, ``component_id`` the smallest id that links reach, the row's own included; null ids count as no id, and a component
    without any id has null.  Repeated rows are linked.  An empty table gives an empty result; extra columns are not carried.
    """
    signed, linked = joined(docs, id_col, text_col, size=size, percent=percent)
    classes = materialise(signed.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("class_id")), "classes")
    if linked is None:
        placed = classes.withColumn("component_id", F.col("class_id"))
    else:
        tied = classes.join(linked[1], F.col("s1") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "s1"))
        least = materialise(tied.groupBy("comp").agg(F.min("class_id").alias("component_id")), "components")
        placed = tied.join(least, "comp").select("s1", "s2", "class_id", "component_id")
    placed = materialise(placed, "placed-classes")
    return signed.join(placed, ["s1", "s2"], "left").select(
        "id", "fp", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(id, fp, n)``: of each component the row of the least id, nulls last, and then of the least fingerprint, and how many rows repeat both.

    Texts without words have no links, so that each of them stands for itself.
    """
    signed, linked = joined(docs, id_col, text_col, size=size, percent=percent)
    rows = signed.groupBy("id", "fp", "s1").agg(F.count("*").alias("n"), F.max("n").alias("size"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "fp", "n")
    firsts = rows.where("size > 0").groupBy("s1").agg(F.min(order).alias("first"))
    if linked is not None:
        tied = firsts.join(linked[1], F.col("s1") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "s1"))
        firsts = tied.groupBy("comp").agg(F.min("first").alias("first"))
    return firsts.select("first.id", "first.fp", "first.n").unionByName(rows.where("size = 0").select("id", "fp", "n"))
