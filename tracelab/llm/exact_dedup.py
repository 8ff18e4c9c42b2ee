"""Exact dedup by an exchange of Golomb-coded fingerprints.

Each block of rows sends its sorted fingerprints to their owners, one coded message per owner of a stretch of the fingerprint range.  An owner decodes what it was
sent and answers every message with a bitmap of the fingerprints that another block, or the block itself, holds again.  Only the
texts behind set bits are shuffled; grouping them by the text itself compares their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import LOWER, UPPER, hash_filter, identified, passing, restored
from tracelab.session import materialise, scratch

BITS = 48  # of a fingerprint: among 10**10 texts one in 30,000 is suspected without cause
BLOCK = 1 << 18  # rows of a block
OWNED = 8  # there are sqrt(rows) / OWNED owners, so that messages and owners grow alike


def normalised(text: Column) -> Column:
    """What makes texts equal: all of it, A-Z lower-cased."""
    return F.translate(text, UPPER, LOWER)


def digest(text: Column) -> Column:
    """SHA-256 of a normalised text."""
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def rice(gaps: np.ndarray, low: int) -> bytes:
    """Golomb code with parameter ``2**low``: all quotients in unary, then all remainders in ``low`` bits."""
    gaps = gaps.astype(np.uint64)
    quotient = (gaps >> np.uint64(low)).astype(np.int64)
    unary = np.ones(int(quotient.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    remainder = (gaps[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(np.concatenate([unary, remainder.astype(np.uint8).ravel()])).tobytes()


def unrice(code: bytes, n: int, low: int) -> np.ndarray:
    """The gaps that ``rice`` coded."""
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.nonzero(bits[: len(bits) - n * low] == 0)[0][:n]
    quotient = np.diff(ends, prepend=-1) - 1
    at = int(ends[-1]) + 1 if n else 0
    remainder = bits[at : at + n * low].reshape(n, low).astype(np.uint64) << np.arange(low, dtype=np.uint64)
    return (quotient.astype(np.uint64) << np.uint64(low)) + remainder.sum(1, dtype=np.uint64)


def coded(prints: np.ndarray, low: int, base: int) -> bytes:
    """Sorted distinct fingerprints from ``base`` on."""
    return rice(np.diff(prints, prepend=np.uint64(base)), low)


def decoded(code: bytes, n: int, low: int, base: int) -> np.ndarray:
    return np.cumsum(unrice(code, n, low), dtype=np.uint64) + np.uint64(base)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, print, sha)`` of every row."""
    text = normalised(F.col("text"))
    return identified(docs, id_col, text_col).select(
        "id", F.shiftrightunsigned(F.xxhash64(text), 64 - BITS).alias("print"), digest(text).alias("sha")
    )


MESSAGE = "block long, owner int, n int, low int, code binary, ids array<long>, shas array<binary>, ranks array<int>"


def _messages(slim: DataFrame, owners: int) -> DataFrame:
    """``(block, owner, n, low, code, ids, shas, ranks)``: what each block sends to each owner, and which rows each fingerprint stands for; ``ranks`` count
    a row's fingerprint among the ``n`` coded ones.
    """
    names = [f.split()[0] for f in MESSAGE.split(", ")]
    stretch = -(-(1 << BITS) // owners)

    def send(block: int, ids: pa.Array, prints: np.ndarray, shas: pa.Array) -> pa.RecordBatch:
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        fresh = np.diff(prints, prepend=~prints[:1]) != 0
        owner = (prints // np.uint64(stretch)).astype(np.int64)
        cuts = np.concatenate([[0], np.nonzero(np.diff(owner))[0] + 1, [len(prints)]])
        ranks = np.cumsum(fresh) - 1
        heads, codes, n, lows = [], [], [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = prints[a:b][fresh[a:b]]
            low = max(int(stretch // (len(own) + 1)).bit_length() - 1, 0)
            heads.append(int(owner[a]))
            codes.append(coded(own, low, heads[-1] * stretch))
            n.append(len(own))
            lows.append(low)
            ranks[a:b] -= ranks[a]
        ends, at = pa.array(cuts, pa.int32()), pa.array(order)
        lists = [pa.ListArray.from_arrays(ends, v) for v in (ids.take(at), shas.take(at), pa.array(ranks, pa.int32()))]
        plain = [pa.array(np.full(len(heads), block)), pa.array(heads, pa.int32()), pa.array(n, pa.int32()), pa.array(lows, pa.int32()), pa.array(codes, pa.binary())]
        return pa.RecordBatch.from_arrays(plain + lists, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, block = [], 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, prints, shas = (c.combine_chunks() for c in whole.columns)
            return send(block, ids, prints.to_numpy().astype(np.uint64), shas)

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                if rows and rows + part.num_rows > BLOCK:
                    yield flush()
                    held, rows, block = [], 0, block + 1
                held.append(part)
                rows += part.num_rows
        if rows:
            yield flush()

    return slim.select("id", "print", "sha").mapInArrow(run, MESSAGE)


def _answers(messages: DataFrame, owners: int) -> DataFrame:
    """``(block, owner, again)``: for each message a bitmap of its fingerprints that other messages to the same owner hold too."""
    stretch = -(-(1 << BITS) // owners)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        base = key[0].as_py() * stretch
        parts = [decoded(c, n, low, base) for n, low, c in zip(*(table.column(x).to_pylist() for x in ("n", "low", "code")), strict=True)]
        prints = np.concatenate(parts)
        _, inverse, counts = np.unique(prints, return_inverse=True, return_counts=True)
        again = np.split(counts[inverse] > 1, np.cumsum([len(p) for p in parts])[:-1])
        return pa.table({"block": table.column("block"), "owner": table.column("owner"), "again": pa.array([np.packbits(a).tobytes() for a in again], pa.binary())})

    return messages.select("block", "owner", "n", "low", "code").groupBy("owner").applyInArrow(answer, "block long, owner int, again binary")


def _resolved(messages: DataFrame, answers: DataFrame, owners: int) -> DataFrame:
    """``(id, sha, print, suspect)`` of every row: whether its bit is set or its own block holds the fingerprint in another row."""
    stretch = -(-(1 << BITS) // owners)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, n, low, code, again = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("owner", "n", "low", "code", "again"))
            ids, shas, ranks = (batch.column(batch.schema.get_field_index(c)) for c in ("ids", "shas", "ranks"))
            for i in range(batch.num_rows):
                rank = ranks[i].values.to_numpy()
                flag = np.unpackbits(np.frombuffer(again[i], np.uint8))[: n[i]].astype(bool) | (np.bincount(rank, minlength=n[i]) > 1)
                prints = decoded(code[i], n[i], low[i], owner[i] * stretch)
                yield pa.RecordBatch.from_arrays(
                    [ids[i].values, shas[i].values, pa.array(prints[rank].astype(np.int64)), pa.array(flag[rank])], ["id", "sha", "print", "suspect"]
                )

    met = messages.join(answers, ["block", "owner"]).select("owner", "n", "low", "code", "again", "ids", "shas", "ranks")
    return met.mapInArrow(read, "id long, sha binary, print long, suspect boolean")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, sha, keep_id, group_size)``: one row per input row.

    Texts are equal if they are the same after A-Z are lower-cased; a null text is empty.  ``keep_id`` is the largest id among equal texts (null ids are the
    smallest, and null where there is no other), ``group_size`` the number of rows with that text, ``sha`` its SHA-256 in bytes.  Rows that
    repeat id and text each count and have the same verdict.  An empty table gives an empty result; extra columns are not carried.
    """
    slim = scratch(_slim(docs, id_col, text_col), "fingerprints")
    owners = max(1, int(slim.df.count() ** 0.5) // OWNED)
    messages = scratch(_messages(slim.df, owners), "messages")
    slim.drop()
    rows = scratch(_resolved(messages.df, _answers(messages.df, owners), owners), "resolved")
    messages.drop()
    single = rows.df.where(~F.col("suspect")).select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    suspects = rows.df.where("suspect").select("id", "sha")
    groups = materialise(_verified(docs, rows.df.where("suspect").select("print").distinct(), id_col, text_col), "verified-groups")
    # a group is one row here, so that a text that very many rows share is joined in pieces
    return single.unionByName(suspects.join(groups, "sha").select("id", "sha", "keep_id", "group_size"))


def _verified(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(sha, keep_id, group_size)`` of the texts behind suspected fingerprints.

    Rows are grouped by the text itself, first within each task, so that equality is that of bytes and a common text travels once per task.
    The filter is of fixed size; when it is full it lets more texts through and loses none.
    """
    spread = F.shiftleft("print", 64 - BITS)
    held = docs.sparkSession.sparkContext.broadcast(hash_filter(prints.select(spread.alias("print")), "print"))

    @F.pandas_udf("boolean")
    def suspected(prints):
        import pandas as pd

        return pd.Series(passing(prints.to_numpy().astype(np.int64).view(np.uint64), held.value))

    texts = identified(docs, id_col, text_col).select("id", normalised(F.col("text")).alias("text"))
    texts = texts.withColumn("print", F.shiftleft(F.shiftrightunsigned(F.xxhash64("text"), 64 - BITS), 64 - BITS)).where(suspected("print"))
    groups = texts.groupBy("text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.select(digest(F.col("text")).alias("sha"), "keep_id", "group_size")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each group of equal texts the one with the largest id, once.

    Of rows that repeat id and text, one stays; of a group without any id, one row.  Nulls, empty tables and texts are as in ``verdicts``.
    """
    stay = materialise(verdicts(docs, id_col, text_col).groupBy("sha").agg(F.max("id").alias("s_id"), F.max("group_size").alias("size")), "stay")
    base = identified(docs, id_col, text_col).withColumn("sha", digest(normalised(F.col("text"))))
    left = base.join(stay.withColumnRenamed("sha", "s_sha"), (F.col("sha") == F.col("s_sha")) & F.col("id").eqNullSafe(F.col("s_id")))
    once = left.where("size = 1").unionByName(left.where("size > 1").dropDuplicates(["sha"]))
    return restored(once, docs)
