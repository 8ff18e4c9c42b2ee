"""Benchmark decontamination with spaced seeds.

A seed is the hash of the tokens that a fixed mask selects in a short window; tokens at the other places may differ.  Seeds of
benchmark and training texts are joined, and around every hit the two token rows are compared place by place, so that an overlap counts
although some of its words were replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.quantile import let
from tracelab.llm.common import IS_SIGN, each_batch, hash_filter, identified, mixed, passing, same_row, words
from tracelab.session import materialise

# fixed values: places of a nine-token window that a seed reads; wherever CHANGED of LEAST tokens in a row differ, one mask at one place reads none of them
MASKS = ("110101011", "101111001", "110010111")
SPAN = 9
CHANGED = 2
LEAST = 12
OVERLAP = 13
SHARE = 0.8


def tokens(texts: list[str]) -> list[np.ndarray]:
    """Hashes of each text's words: runs of letters, digits and underscores, all beyond ASCII among them, A-Z lower-cased."""
    return words(texts, IS_SIGN)


def seeds(toks: np.ndarray) -> np.ndarray:
    """One row of seeds for each mask, a column for each window; empty if the text is shorter than a window."""
    n = len(toks) - SPAN + 1
    out = np.zeros((len(MASKS), max(n, 0)), np.uint64)
    for m, mask in enumerate(MASKS if n > 0 else ()):
        total = np.full(n, m + 1, np.uint64)
        for at, read in enumerate(mask):
            if read == "1":
                total *= np.uint64(0x2545F4914F6CDD1D)
                total += toks[at : at + n]
                total ^= total >> np.uint64(32)
        out[m] = mixed(total)
    return out


def _benchmark(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, item_fp, tokens, seeds)``: signed hashes of the items, one row each."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        toks, found = [], []
        for t in tokens(batch.column(2).to_pylist()):
            s = seeds(t if len(t) >= LEAST else t[:0])
            toks.append(t.view(np.int64))
            found.append(s.T.reshape(-1).view(np.int64))
        longs = [pa.array(x, pa.list_(pa.int64())) for x in (toks, found)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs], ["item", "item_fp", "tokens", "seeds"])

    items = identified(benchmark, id_col, text_col).select(F.col("id").alias("item"), F.col("fp").alias("item_fp"), "text").distinct()
    return items.mapInArrow(each_batch(read), "item long, item_fp long, tokens array<long>, seeds array<long>")


def _regions(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``(id, fp, start, tokens, seeds, places)``: stretches of training texts around windows whose seed may be the benchmark's."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = shared.value
        rows: list[list] = [[] for _ in range(6)]
        ids, fps, texts = (c.to_pylist() for c in batch.columns)
        each = tokens(texts)
        t = np.concatenate([np.zeros(0, np.uint64), *each])
        owner = np.repeat(np.arange(len(each)), [len(e) for e in each])
        begin = np.cumsum([0, *(len(e) for e in each)])
        s = seeds(t)
        inside = owner[: s.shape[1]] == owner[SPAN - 1 :][: s.shape[1]]  # windows do not cross from one text to the next
        hit_at, hit_mask = np.nonzero((passing(s, bits) & inside).T)
        if len(hit_at):
            new = (np.diff(hit_at) > 2 * OVERLAP + SPAN) | (np.diff(owner[hit_at]) > 0)
            for g in np.split(np.arange(len(hit_at)), np.nonzero(new)[0] + 1):
                n = int(owner[hit_at[g[0]]])
                start, end = max(int(begin[n]), int(hit_at[g[0]]) - OVERLAP), min(int(begin[n + 1]), int(hit_at[g[-1]]) + SPAN + OVERLAP)
                found = s[hit_mask[g], hit_at[g]].view(np.int64)
                for col, v in zip(rows, (ids[n], fps[n], start - int(begin[n]), t[start:end].view(np.int64), found, hit_at[g] - begin[n]), strict=True):
                    col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["id", "fp", "start", "tokens", "seeds", "places"])

    schema = "id long, fp long, start long, tokens array<long>, seeds array<long>, places array<long>"
    return docs.select("id", "fp", "text").mapInArrow(each_batch(read), schema)


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    *, overlap: int = OVERLAP, share: float = SHARE,
) -> DataFrame:
    """``(id, fp, item, n_same, n_compared)``: documents that hold a stretch of a benchmark item, one row per document text and item.

    A stretch is a window of ``overlap`` (``LEAST`` to ``OVERLAP``) words in which at least ``share`` of the words are equal place by place, whichever
    these are: the masks find every window with up to ``CHANGED`` other words, and a lower share is refused.  An item of ``LEAST`` words is one window, and one of
    fewer words is no evidence.  ``n_same`` of ``n_compared`` words around the stretch are equal (the best alignment counts).  Words are
    compared with A-Z in lower case and without signs.  Null or empty texts hold nothing; rows that repeat id and text are one row of the result; null ids are kept.
    Without documents or without items the result is empty; extra columns are not carried.
    """
    if not LEAST <= overlap <= OVERLAP:
        raise ValueError(f"an overlap of {LEAST} to {OVERLAP} words")
    if max(n - math.ceil(n * share) for n in (LEAST, overlap)) > CHANGED:
        raise ValueError(f"a share that lets at most {CHANGED} words differ")
    items = materialise(_benchmark(benchmark, item_col, item_text), "benchmark-items")
    regions = materialise(_regions(identified(docs, id_col, text_col), hash_filter(items.select(F.explode("seeds").alias("seed")), "seed")), "seed-regions")
    own = items.select("item", "item_fp", F.posexplode("seeds").alias("n", "seed")).select(
        "item", "item_fp", "seed", F.floor(F.col("n") / len(MASKS)).alias("item_at")
    )
    hits = regions.select("id", "fp", "start", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(
        "id", "fp", "start", F.col("s.seeds").alias("seed"), F.col("s.places").alias("at")
    )
    lines = hits.join(own, "seed").select("id", "fp", "start", "item", "item_fp", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    r, k = regions.drop("seeds", "places").withColumnRenamed("tokens", "theirs").distinct(), items.select(F.col("item").alias("k_item"), F.col("item_fp").alias("k_fp"), "tokens")
    pairs = lines.join(k, F.col("item").eqNullSafe(F.col("k_item")) & (F.col("item_fp") == F.col("k_fp"))).drop("k_item", "k_fp")
    pairs = pairs.join(r.withColumnRenamed("id", "r_id").withColumnRenamed("fp", "r_fp").withColumnRenamed("start", "r_start"),
                       F.col("id").eqNullSafe(F.col("r_id")) & (F.col("fp") == F.col("r_fp")) & (F.col("start") == F.col("r_start")))
    low = F.greatest(F.lit(0), F.col("start") - F.col("shift"))
    size = F.least(F.size("tokens"), F.col("start") + F.size("theirs") - F.col("shift")) - low
    width = F.least(F.lit(overlap), F.size("tokens"))
    pairs = pairs.withColumn("low", low.cast("int")).withColumn("n", size.cast("int")).withColumn("width", width)
    same = F.zip_with(
        F.slice("tokens", F.col("low") + 1, F.col("n")),
        F.slice("theirs", (F.col("shift") + F.col("low") - F.col("start") + 1).cast("int"), F.col("n")),
        lambda a, b: (a == b).cast("int"),
    )
    total = lambda flags: F.aggregate(flags, F.lit(0), lambda a, x: a + x)

    def best(flags: Column) -> Column:
        return F.array_max(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("width")), lambda i: total(F.slice(flags, i + 1, F.col("width")))))

    judged = pairs.where(F.col("n") >= F.col("width")).select(
        "id", "fp", "item", "width", "n", let(same, lambda flags: F.struct(best(flags).alias("best"), total(flags).alias("same"))).alias("m")
    )
    good = judged.where(F.col("m.best") >= F.ceil(F.col("width") * F.lit(share)))
    top = F.max(F.struct(F.col("m.same").cast("long").alias("same"), F.col("n").cast("long").alias("n")))
    return good.groupBy("id", "fp", "item").agg(top.alias("top")).select("id", "fp", "item", F.col("top.same").alias("n_same"), F.col("top.n").alias("n_compared"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents without an overlap, with all their columns."""
    held = materialise(overlaps(docs, benchmark, id_col, text_col, **how).select("id", "fp").distinct(), "contaminated")
    base = identified(docs, id_col, text_col)
    return base.join(held, same_row(base, held), "left_anti").select("row.*")
