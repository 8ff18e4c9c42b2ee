"""Suffix-array dedup: repeated strings out of common-prefix interval trees.

A suffix array of the whole corpus is not built in one place.  Every 400-byte window names one of its places, the least hash of all
100-byte strings in it, so that equal windows name the same string at the same distance.  Suffixes that start at named places whose hash is
seen twice are gathered by that hash, and each gathering gets its own enhanced suffix array: suffixes sorted by what follows, common prefix
lengths, and a stack scan that yields the interval tree.  An interval's suffixes are sorted by what precedes them and scanned again; where
left extensions differ, an interval is a maximal repeat with all its occurrences, of the length that both sides have in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import BYTE_VALUES, each_batch, hash_filter, identified, mixed, passing, power, same_row
from tracelab.session import materialise, scratch

LENGTH = 400
GRAM = 100
REACH = LENGTH - GRAM  # farthest a window may start in front of the place it names
GATHERED = 20_000  # suffixes in one tree; larger gatherings compare stretches of windows by hash, which any number of tasks can share
PER_TASK = 20_000
STRETCH = 1 << 18  # bytes that are hashed at a time
SENT = 500_000  # kinds of suffix that a task remembers having sent

def string_hashes(data: bytes, size: int, which: int = 0) -> np.ndarray:
    """A hash of every string of ``size`` bytes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[which][np.frombuffer(data, np.uint8)] * power(which, len(data), False), dtype=np.uint64, out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * power(which, n, True))


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or largest value of every window, by doubling."""
    out, done = values, 1
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(values) - width + 1], out[width - done : len(values) - width + 1 + width - done]) if done < width else out


def named_places(data: bytes, ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(place, hash, first, last)``: places that windows name, and the first and last window that name each.

    ``data`` may be several texts one after the other, each up to its place in ``ends``; windows do not cross from one to the next.
    """
    h = string_hashes(data, GRAM)
    windows = len(data) - LENGTH + 1
    if windows <= 0:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none
    least = _sliding(h, REACH + 1, np.minimum)
    for end in ends[:-1]:
        least[max(0, end - LENGTH + 1) : end] = 0
    padded = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
    at = np.nonzero(_sliding(padded, REACH + 1, np.maximum) == h)[0]  # a place is named if the largest minimum around it is its own
    mine = h[at]
    bounds = np.array([0, *ends])
    text = np.searchsorted(bounds, at, "right") - 1
    first, last = np.maximum(at - REACH, bounds[text]), np.minimum(at, bounds[text + 1] - LENGTH)
    below = mine[1:] < mine[:-1]
    last[:-1] = np.where(below, np.minimum(last[:-1], at[1:] - REACH - 1), last[:-1])
    below = mine[:-1] < mine[1:]
    first[1:] = np.where(below, np.maximum(first[1:], at[:-1] + 1), first[1:])
    good = first <= last
    return at[good], mine[good], first[good], last[good]


def stretches(texts: list[str]) -> Iterator[tuple[bytes, list[int], list[tuple[int, int]]]]:
    """Texts as bytes in pieces of bounded size: ``(data, ends, origins)`` with the text and offset that each part of the data comes from.

    A long text is cut into parts that overlap by one byte less than a window, so that every window is in one part.
    """
    parts: list[bytes] = []
    ends: list[int] = []
    origins: list[tuple[int, int]] = []
    size = 0
    for n, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        for at in range(0, len(raw) - LENGTH + 1, STRETCH):
            part = raw[at : at + STRETCH + LENGTH - 1]
            size += len(part)
            parts.append(part)
            ends.append(size)
            origins.append((n, at))
            if size >= STRETCH:
                yield b"".join(parts), ends, origins
                parts, ends, origins, size = [], [], [], 0
    if parts:
        yield b"".join(parts), ends, origins


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def intervals(shared: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The interval tree of a sorted list: ``(common, i, j)`` for every run ``i:j`` that shares ``common`` bytes, ``least`` at least, and cannot be longer.

    ``shared[k]`` is what the elements ``k`` and ``k + 1`` have in common.
    """
    stack: list[tuple[int, int]] = []
    for at, common in enumerate([*shared, -1], 1):
        begin = at - 1
        while stack and stack[-1][0] > common:
            depth, begin = stack.pop()
            yield depth, begin, at
        if common >= least and (not stack or stack[-1][0] < common):
            stack.append((common, begin))


def _sorted(keys: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Order of the keys, and what neighbours have in common."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return np.array(order), [common_prefix(keys[a], keys[b]) for a, b in pairwise(order)]


class _Minima:
    """Least value of any range of a list, from minima of ranges of doubled width."""

    def __init__(self, values: list[int]):
        self.levels = [np.array(values)]
        while len(self.levels[-1]) > (w := 1 << (len(self.levels) - 1)):
            self.levels.append(np.minimum(self.levels[-1][:-w], self.levels[-1][w:]))
        self.table = np.zeros((len(self.levels), len(values)), np.int64)
        for row, level in zip(self.table, self.levels, strict=True):
            row[: len(level)] = level

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Least values of ``begin:end``, none of them empty."""
        level = np.log2(end - begin).astype(np.int64)
        return np.minimum(self.table[level, begin], self.table[level, end - (1 << level)])


def maximal_repeats(before: list[bytes], after: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(right, members, left)``: repeats of at least ``length`` bytes around a place, with all suffixes that hold them.

    ``before`` holds what precedes each suffix, last byte first.  Members, in the order of what precedes them, share ``right`` bytes from the place on
    and no more all together; ``left`` says how many bytes in front neighbours share.  Its least value is what all members share, and
    there their left extensions differ.
    """
    by_after, shared_after = _sorted(after)
    by_before, shared_before = _sorted(before)
    rank = np.empty(len(before), np.int64)
    rank[by_before] = np.arange(len(before))
    least = _Minima(shared_before)
    for right, i, j in intervals(shared_after, max(1, length - max(map(len, before)))):
        run = np.sort(rank[by_after[i:j]])
        left = least.of(run[:-1], run[1:])
        edges = np.nonzero(left < length - right)[0]  # too little in common: other repeats
        begin = 0
        for edge in [*edges.tolist(), len(run) - 1]:
            if edge > begin:
                yield right, by_before[run[begin : edge + 1]], left[begin:edge]
            begin = edge + 1


def reaches(before: list[bytes], after: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """How far each suffix is repeated in front of its place and from it on, -1 if it is in no repeat.

    Its repeats all hold the place, so that together they reach as far as the farthest on either side.
    """
    front, back = np.full(len(before), -1), np.full(len(before), -1)
    if len(before) == 2:
        left, right = common_prefix(*before), common_prefix(*after)
        if left + right >= length:
            front[:], back[:] = left, right
        return front, back
    for right, members, left in maximal_repeats(before, after, length):
        best = np.maximum(np.concatenate([left, left[-1:]]), np.concatenate([left[:1], left]))
        front[members] = np.maximum(front[members], best)
        back[members] = np.maximum(back[members], right)
    return front, back


def _places(docs: DataFrame) -> DataFrame:
    """``(hash)`` of every named place."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [named_places(data, ends)[1] for data, ends, _ in stretches(batch.column(0).to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64), pa.int64())], ["hash"])

    return docs.select("text").mapInArrow(each_batch(read), "hash long")


SUFFIX = "hash long, c1 long, c2 long, id long, fp long, place long, front long, back long, before binary, after binary"


def _suffixes(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Suffixes at named places that the filter passes.

    ``c1, c2`` is a hash of the bytes that the place's windows cover, ``front`` before it and ``back`` from it on.  The bytes themselves come
    with the first suffix of their kind in a task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    names = [f.split()[0] for f in SUFFIX.split(", ")]
    kinds = [pa.int64()] * 8 + [pa.binary()] * 2

    sent: dict[int, set[int]] = {}

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in names]
        task = TaskContext.get().taskAttemptId()
        if task not in sent:  # what this task has sent; bounded, since to send bytes again does no harm
            sent.clear()
            sent[task] = set()
        seen = sent[task]
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)
        ids, fps, texts = (c.to_pylist() for c in batch.columns)
        for data, ends, origins in stretches(texts):
            at, h, first, last = named_places(data, ends)
            keep = passing(h, shared.value)
            at, h, first, last = at[keep], h[keep], first[keep], last[keep]
            part = np.searchsorted(ends, at, "right")
            for p, s, a, b, k in zip(at.tolist(), h.view(np.int64).tolist(), first.tolist(), last.tolist(), part.tolist(), strict=True):
                digest = xxhash.xxh3_128_digest(data[a : b + LENGTH], seed=p - a)
                c1, c2 = int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)
                new = c1 not in seen
                if new:
                    if len(seen) >= SENT:
                        seen.clear()
                    seen.add(c1)
                whole = (data[a:p][::-1], data[p : b + LENGTH]) if new else (None, None)
                n, offset = origins[k]
                place = p - (ends[k - 1] if k else 0) + offset
                for col, v in zip(rows, (s, c1, c2, ids[n], fps[n], place, p - a, b + LENGTH - p, *whole), strict=True):
                    col.append(v)
                if len(rows[0]) >= 4096:
                    yield out()
                    rows = [[] for _ in names]
        yield out()

    return docs.select("id", "fp", "text").mapInArrow(each_batch(read), SUFFIX)


def _tree_spans(gathered: DataFrame) -> DataFrame:
    """``(c1, c2, front, back)``: stretches around the place that the trees find repeated."""

    def grow(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("hash", "c1", "c2", "before", "after")), strict=True), key=lambda r: r[:3])
        out: list[tuple[int, int, int, int]] = []
        at = 0
        while at < len(rows):
            end = at
            kinds: dict[tuple[int, int], tuple[bytes, bytes]] = {}
            while end < len(rows) and rows[end][0] == rows[at][0]:
                kinds[rows[end][1:3]] = rows[end][3:]
                end += 1
            at = end
            if len(kinds) < 2:
                continue
            ids, before, after = list(kinds), [v[0] for v in kinds.values()], [v[1] for v in kinds.values()]
            front, back = reaches(before, after)
            out += [(*ids[m], int(front[m]), int(back[m])) for m in np.nonzero(front >= 0)[0].tolist()]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["c1", "c2", "front", "back"])

    return gathered.groupBy("bucket").applyInArrow(grow, "c1 long, c2 long, front long, back long")


PARTS = 7  # into so many parts a stretch of window starts is cut: 301 starts are cut three times


def cuts(lo: int, hi: int) -> list[tuple[int, int]]:
    """A stretch of window starts in parts."""
    step = -(-(hi - lo + 1) // PARTS)
    return [(a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)]


NODE = "c1 long, c2 long, lo int, hi int, k1 long, k2 long, h1 long, h2 long"


def _nodes(wanted: DataFrame) -> DataFrame:
    """``(c1, c2, lo, hi, k1, k2, h1, h2)`` of ``(c1, c2, before, after, lows, highs)``: each stretch ``lo … hi`` of bytes that a window may start in front of the
    place, cut into parts.

    ``k1, k2`` is a hash of what all windows of the part share, ``h1, h2`` of all bytes that they cover; where the text ends before, the latter stands for
    the suffix alone.
    """
    names = [f.split()[0] for f in NODE.split(", ")]

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list[int]] = [[] for _ in names]
        for c1, c2, before, after, lows, highs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            first, last = max(0, LENGTH - len(after)), len(before)  # windows that the text holds
            for lo, hi in (part for stretch in zip(lows, highs, strict=True) for part in cuts(*stretch)):
                if lo > last or hi < first:
                    continue
                inner = xxhash.xxh3_128_digest(before[:lo] + b"|" + after[: LENGTH - hi])
                whole = first <= lo and hi <= last
                outer = xxhash.xxh3_128_digest(before[:hi] + b"|" + after[: LENGTH - lo]) if whole else xxhash.xxh3_128_digest(b"%d %d" % (c1, c2))
                ints = [int.from_bytes(d[at : at + 8], "big", signed=True) for d in (inner, outer) for at in (0, 8)]
                for col, v in zip(rows, (c1, c2, lo, hi, *ints), strict=True):
                    col.append(v)
        kinds = [pa.int32() if f.endswith(" int") else pa.int64() for f in NODE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

    return wanted.select("c1", "c2", "before", "after", "lows", "highs").mapInArrow(each_batch(read, 64), NODE)


def _part_spans(large: DataFrame) -> DataFrame:
    """The same for gatherings of any size, which no tree in one task could hold.

    Windows start in stretches in front of the place.  Suffixes that share all bytes a stretch's windows cover share all of the windows; suffixes that do not
    even share what these have in common share none.  Only where neither holds is a stretch cut into parts, once for all suffixes that
    agree on it.  A suffix has few such stretches, at the edges of what it repeats.
    """
    kinds = large.groupBy("hash", "c1", "c2").agg(F.first("before").alias("before"), F.first("after").alias("after"))
    kinds = scratch(kinds, "large-gatherings")
    wanted = kinds.df.withColumns({"lows": F.array(F.lit(0)), "highs": F.array(F.lit(REACH))})
    found: DataFrame | None = None
    while True:
        nodes = scratch(_nodes(wanted), "stretches")
        part, inner, outer = ["lo", "hi"], ["k1", "k2"], ["h1", "h2"]
        agree = scratch(nodes.df.groupBy(*part, *inner, *outer).agg(F.count("*").alias("n"), F.min(F.struct("c1", "c2")).alias("one")), "agreeing")
        shared = nodes.df.join(agree.df.where("n >= 2").drop("n", "one"), [*part, *inner, *outer]).select(
            "c1", "c2", F.col("hi").cast("long").alias("front"), (LENGTH - F.col("lo")).cast("long").alias("back")
        )
        shared = materialise(shared, "shared-stretches")
        found = shared if found is None else found.unionByName(shared)
        several = agree.df.groupBy(*part, *inner).agg(F.count("*").alias("kinds")).where("kinds >= 2 AND lo < hi").drop("kinds")
        open_parts = agree.df.join(several, [*part, *inner]).select("one.c1", "one.c2", "lo", "hi")
        each = scratch(open_parts.groupBy("c1", "c2").agg(F.collect_list("lo").alias("lows"), F.collect_list("hi").alias("highs")), "open-stretches")
        nodes.drop()
        agree.drop()
        if each.df.isEmpty():
            kinds.drop()
            return found.groupBy("c1", "c2").agg(F.max("front").alias("front"), F.max("back").alias("back"))
        wanted = kinds.df.join(each.df, ["c1", "c2"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, spans)``: stretches of a text's bytes, ``(start, end)``, that together are all its bytes in a repeated 400-byte string.

    Texts without any have no row.  Spans may overlap.
    """
    base = identified(docs, id_col, text_col).where(F.octet_length("text") >= LENGTH).select("id", "fp", "text")
    twice = _places(base).groupBy("hash").agg(F.count("*").alias("n")).where("n >= 2")
    suffixes = materialise(_suffixes(base, hash_filter(twice, "hash")), "suffixes")
    same = suffixes.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n >= 2").select("c1", "c2", F.lit(None).cast("long").alias("front"), F.lit(None).cast("long").alias("back"))
    bytes_of = suffixes.where(F.col("before").isNotNull()).select("hash", "c1", "c2", "before", "after")
    sizes = materialise(suffixes.select("hash", "c1", "c2").distinct().groupBy("hash").agg(F.count("*").alias("n")).where("n >= 2"), "gatherings")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    gathered = bytes_of.join(sizes, "hash")
    buckets = max(1, total // PER_TASK)
    small = gathered.where(F.col("n") <= GATHERED).withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(buckets)))
    large = gathered.where(F.col("n") > GATHERED)
    found = materialise(same.unionByName(_tree_spans(small)).unionByName(_part_spans(large)), "repeats")
    spans = suffixes.join(found.withColumnsRenamed({"front": "f", "back": "b"}), ["c1", "c2"]).select(
        "id", "fp", F.struct((F.col("place") - F.coalesce("f", "front")).alias("start"), (F.col("place") + F.coalesce("b", "back")).alias("end")).alias("span")
    )
    return spans.groupBy("id", "fp").agg(F.collect_set("span").alias("spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, n_bytes, n_removed, n_spans, kept)``: one row per input row, ``kept`` the bytes that are in no repeated 400-byte string.

    A string counts as repeated if it starts at two places, in two rows or in one; the first occurrence goes too.  A null text is empty;
    texts under 400 bytes stay; a repeated row of 400 bytes or more loses all.  An empty table gives an empty result; extra columns are not carried.
    ``kept`` may begin or end inside a character.
    """
    base = identified(docs, id_col, text_col).select("id", "fp", "text")
    spans = materialise(repeated_spans(docs, id_col, text_col), "repeated-spans")
    both = base.join(spans, same_row(base, spans), "left").select(base["id"], base["fp"], "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    names = ["id", "fp", "n_bytes", "n_removed", "n_spans", "kept"]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, gone, runs, left = [], [], [], []
        for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            kept, at, n = [], 0, 0
            reach = -1
            for a, b in sorted(zip(starts or [], ends or [], strict=True)):
                if a > reach:  # touching spans are one run
                    n += 1
                    kept.append(data[at:a])
                at = reach = max(reach, b)
            kept.append(data[at:])
            out = b"".join(kept)
            sizes.append(len(data))
            gone.append(len(data) - len(out))
            runs.append(n)
            left.append(out)
        ints = [pa.array(c, pa.int64()) for c in (sizes, gone, runs)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *ints, pa.array(left, pa.binary())], names)

    return both.mapInArrow(each_batch(cut), "id long, fp long, n_bytes long, n_removed long, n_spans long, kept binary")


