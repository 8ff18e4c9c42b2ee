"""What the corpus operators share: whole texts, row identity, array helpers, Arrow batches.

Every operator keeps the caller's columns in one struct ``row``, so that extra columns may have any name.  A row is known by
its id and a fingerprint of its text: rows that repeat both are equal, and every join on the two gives each of them the same answer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.quantile import let

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
WORD_BREAK = r"[\x20\x09-\x0D]+"


def named(col: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col(f"`{col}`")


def whole(text: Column) -> Column:
    """The whole text; a null is an empty text."""
    return F.coalesce(text, F.lit(""))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, id, fp, text)``: the caller's columns in a struct, the id, the text's fingerprint and the whole text."""
    text = whole(named(text_col))
    return docs.select(
        F.struct(*[named(c) for c in docs.columns]).alias("row"),
        named(id_col).cast("long").alias("id"),
        F.xxhash64(text).alias("fp"),
        text.alias("text"),
    )


def restored(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The caller's columns out of ``row``, with some of them replaced."""
    return df.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on the identity of a row; null ids are equal."""
    return left["id"].eqNullSafe(right["id"]) & (left["fp"] == right["fp"])


def running_sums(values: Column, block: int = 256) -> Column:
    """Sums of all values before each element, in two levels so that long arrays stay linear."""

    def prefix(items: Column, start: Column) -> Column:
        state = F.struct(F.array().cast("array<long>").alias("out"), start.cast("long").alias("sum"))
        return F.aggregate(
            items, state, lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["sum"])).alias("out"), (acc["sum"] + x).alias("sum"))
        )["out"]

    def blocks(v: Column) -> Column:
        count = F.ceil(F.size(v) / F.lit(block)).cast("int")
        cut = F.when(F.size(v) == 0, F.array().cast("array<array<bigint>>")).otherwise(
            F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(v, b * block + 1, F.lit(block)))
        )
        return let(cut, lambda c: let(
            prefix(F.transform(c, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)),
            lambda starts: F.flatten(F.transform(c, lambda part, i: prefix(part, F.get(starts, i)))),
        ))

    return let(values, blocks)


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words, in order."""
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(text: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; a shorter text is one run, an empty one has none."""

    def runs(words: Column) -> Column:
        return (
            F.when(F.size(words) >= size, F.transform(
                F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
            ))
            .when(F.size(words) > 0, F.array(F.xxhash64(words)))
            .otherwise(F.array().cast("array<long>"))
        )

    return let(word_hashes(text), runs)


def each_batch(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], rows: int = 128):
    """A function for ``mapInArrow`` that hands ``fn`` at most ``rows`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                made = fn(batch.slice(at, rows))
                if isinstance(made, pa.RecordBatch):
                    yield made
                else:
                    yield from made

    return run


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit sums and products."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_rng = np.random.default_rng(400)
BYTE_VALUES = _rng.integers(0, 2**64, (2, 256), np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def power(which: int, n: int, inverse: bool) -> np.ndarray:
    """Powers of a base, or of its inverse modulo 2**64."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[which], -1, 2**64) if inverse else _BASES[which]
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 1 << 20:
            _powers[which, inverse] = have
    return have[:n]


BLANK = re.compile(rb"[\x20\x09-\x0D]")
IS_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
IS_SIGN = np.array([b < 128 and not chr(b).isalnum() and chr(b) != "_" for b in range(256)])
TEXT_BYTES = 1 << 18  # bytes whose words are hashed at a time
FOLDED = BYTE_VALUES[0].copy()
FOLDED[65:91] = FOLDED[97:123]


def _word_parts(texts: list[str]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Texts as bytes in pieces of bounded size, cut between words: ``(data, ends, owners)`` with the text that each part belongs to."""
    parts: list[bytes] = []
    ends: list[int] = []
    owners: list[int] = []
    size = 0
    for n, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        at = 0
        while at < len(raw):
            cut = BLANK.search(raw, at + TEXT_BYTES)
            end = cut.end() if cut else len(raw)
            parts.append(raw[at:end] + b" ")
            at = end
            size += len(parts[-1])
            ends.append(size)
            owners.append(n)
            if size >= TEXT_BYTES:
                yield b"".join(parts), ends, owners
                parts, ends, owners, size = [], [], [], 0
    if parts:
        yield b"".join(parts), ends, owners


def words(texts: list[str], between: np.ndarray = IS_BLANK) -> list[np.ndarray]:
    """Hashes of the words of each text, A-Z as a-z, in order: sums of byte values times powers, brought to a common place.

    ``between`` says which bytes are between words; blanks must be.
    """
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for data, ends, owners in _word_parts(texts):
        raw = np.frombuffer(data, np.uint8)
        inside = ~between[raw]
        edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
        starts, stops = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]  # the data ends in a blank
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(FOLDED[raw] * power(0, len(raw), False), dtype=np.uint64, out=sums[1:])
        hashes = mixed((sums[stops] - sums[starts]) * power(0, len(raw), True)[starts])
        for n, part in zip(owners, np.split(hashes, np.searchsorted(starts, ends[:-1])), strict=True):
            found[n].append(part)
    none = np.zeros(0, np.uint64)
    return [f[0] if len(f) == 1 else np.concatenate([none, *f]) for f in found]


BITS = 26  # a filter of hashes has 2**BITS bits, whatever the number of hashes


def probes(h: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that belong to a hash."""
    return h >> np.uint64(64 - bits), (h >> np.uint64(64 - 2 * bits)) & np.uint64(2**bits - 1)


def hash_filter(hashes: DataFrame, col: str) -> np.ndarray:
    """Signed hashes of a column as one bitmap of fixed size, merged from partial bitmaps; more hashes only make it let more through."""
    h = F.col(col)
    bits = F.array(F.shiftrightunsigned(h, 64 - BITS), F.shiftrightunsigned(h, 64 - 2 * BITS).bitwiseAND(2**BITS - 1))
    bit = F.explode(F.transform(bits, lambda b: b + 1)).alias("bit")
    parts = hashes.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    out = np.zeros(2**BITS // 8, np.uint8)
    for bucket, part in parts.collect():
        at = (bucket - 1) * 4096
        out[at : at + len(part)] = np.frombuffer(part, np.uint8)
    return out


def passing(h: np.ndarray, bits: np.ndarray, places: Callable = probes) -> np.ndarray:
    """Which hashes the filter may hold."""
    one, two = places(h, bits.size.bit_length() + 2)
    held = lambda p: ((bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    out = held(one)
    if out.any():
        out[out] = held(two[out])
    return out


KEPT = 40  # leading bits by which a hash is told from others where repeated ones are looked for
BLOCKS = 8  # the filter of repeated hashes has 2**BLOCKS blocks, each filled by itself
PACKED = 1 << 20  # hashes that a task sorts and packs at a time


def block_probes(h: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a filter of counted hashes that belong to a hash: both in the block that its first ``BLOCKS`` bits name."""
    h = h >> np.uint64(64 - KEPT)
    block = (h >> np.uint64(KEPT - BLOCKS)) << np.uint64(bits - BLOCKS)
    spread = mixed(h)
    inside = np.uint64(2 ** (bits - BLOCKS) - 1)
    return block | (spread >> np.uint64(64 - bits + BLOCKS)), block | (spread & inside)


def filter_bits(hashes: int) -> int:
    """How wide a filter of counted hashes is to be: beyond some hundred million it grows with them, up to 32 MB."""
    return BITS + min(2, max(0, (hashes >> 27).bit_length()))


def repeated_filter(rows: DataFrame, read: Callable[[pa.RecordBatch], np.ndarray], bits: int = BITS) -> np.ndarray:
    """The bitmap, for ``passing`` with ``block_probes``, of all hashes that ``read`` finds more than once in batches of the rows."""
    return count_filters(rows, read, (2,), bits)[0]


def count_filters(rows: DataFrame, read: Callable[[pa.RecordBatch], np.ndarray], least: Sequence[int], bits: int = BITS) -> list[np.ndarray]:
    """For each number of ``least`` the bitmap, for ``passing`` with ``block_probes``, of all hashes that ``read`` finds so often in batches of the rows.

    Hashes are dealt to buckets by their first bits and travel as sorted arrays of the next ones, four bytes each.  Hashes that agree in their first
    ``KEPT`` bits count as equal, which only lets more through.  The first bitmap has ``2**bits`` bits, the others, which hold fewer hashes, a quarter of them.
    """
    widths = [bits if i == 0 else bits - 2 for i in range(len(least))]
    begin = np.cumsum([0, *(2**w // 8 // 4096 for w in widths)])
    first = min(20, max(BLOCKS, (rows.rdd.getNumPartitions() - 1).bit_length()))  # a bucket grows no larger than a part of the input
    rest = np.uint64(KEPT - first)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            h = np.sort(np.concatenate([np.zeros(0, np.uint64), *held])) >> np.uint64(64 - KEPT)
            cuts = np.searchsorted(h >> rest, np.arange((1 << first) + 1, dtype=np.uint64))
            low = (h & np.uint64((1 << int(rest)) - 1)).astype(np.uint32)
            blobs = pa.Array.from_buffers(pa.binary(), 1 << first, [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(low)])
            some = pa.array(np.diff(cuts) > 0)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(1 << first)), blobs], ["bucket", "low"]).filter(some)

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                held.append(read(batch.slice(at, 128)))
                size += len(held[-1])
                if size >= PACKED:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked(bucket: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
            low = np.sort(np.frombuffer(b"".join(held), np.uint32))
            edges = np.concatenate([[0], np.nonzero(low[1:] != low[:-1])[0] + 1, [len(low)]])
            low, times = low[edges[:-1]], np.diff(edges)
            for number, width, start in zip(least, widths, begin, strict=False):
                often = low[times >= number].astype(np.uint64) | (np.uint64(bucket) << rest)
                block = np.zeros(2 ** (width - BLOCKS), bool)
                for place in block_probes(often << np.uint64(64 - KEPT), width):
                    block[place & np.uint64(len(block) - 1)] = True
                pieces = np.packbits(block, bitorder="little").reshape(-1, 4096)
                some = np.nonzero(pieces.any(1))[0]
                at = start + (bucket >> (first - BLOCKS)) * len(pieces)
                yield pa.RecordBatch.from_arrays([pa.array(some + at, pa.int64()), pa.array([pieces[k].tobytes() for k in some], pa.binary())], ["piece", "map"])

        now, held = -1, []
        for batch in batches:
            for bucket, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield from marked(now, held)
                    held = []
                now = bucket
                held.append(low)
        if held:
            yield from marked(now, held)

    packed = rows.mapInArrow(pack, "bucket long, low binary").repartition("bucket").sortWithinPartitions("bucket")
    maps = packed.mapInArrow(gather, "piece long, map binary").groupBy("piece").agg(F.bitmap_or_agg("map").alias("map"))
    out = np.zeros((begin[-1], 4096), np.uint8)
    for piece, part in maps.collect():
        out[piece] = np.frombuffer(part, np.uint8)
    return [out[a:b].reshape(-1) for a, b in zip(begin[:-1], begin[1:], strict=True)]


class Memo(dict):
    """A bounded cache in two generations: filled on a miss; when full, the entries become the older generation.

    What ``keep`` refuses is computed each time.
    """

    def __init__(self, fn: Callable, most: int, keep: Callable | None = None):
        super().__init__()
        self.fn, self.most, self.keep, self.old = fn, most, keep, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
            if self.keep is not None and not self.keep(key):
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
