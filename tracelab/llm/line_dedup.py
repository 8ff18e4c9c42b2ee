"""Line dedup: drop lines that many documents share.

Lines are exploded, normalised and hashed; the documents of each hash are counted, and lines over the threshold go from every
document but the smallest id that holds them.  What is left is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.quantile import let
from tracelab.llm.common import BLANKS, LOWER, UPPER, identified, same_row
from tracelab.session import materialise

LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    """The line without outer blanks, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``(row, n_lines, n_dropped, kept)``: one row per input row, ``row`` holding all its columns.

    A line's key has at least ``min_chars`` code points and occurs in at least ``min_docs`` documents, else the line stays.  A null or
    empty text is one empty line.  Rows with one id are one document; rows without an id are together one document that comes
    last.  If every line goes, ``kept`` is empty.  An empty table gives an empty result.  A key is 128 bits of hash.
    """
    base = identified(docs, id_col, text_col)
    lines = (
        base.select(F.coalesce("id", F.lit(LAST)).alias("doc"), "id", "fp", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "id", "fp", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    shared = (
        lines.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.min("doc").alias("first"))
        .where(F.col("docs") >= min_docs).drop("docs")
    )
    shared = materialise(shared, "shared-lines")  # small beside the lines, so that a line found everywhere can be joined in pieces
    drops = (
        lines.join(shared, ["h1", "h2"]).where(F.col("doc") != F.col("first"))
        .groupBy("id", "fp").agg(F.collect_set("pos").alias("drops"))
    )
    split = F.split("text", "\n")
    kept = let(split, lambda all_lines: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("drops")), lambda i: F.get(all_lines, i)), "\n"
    ))
    return base.join(drops, same_row(base, drops), "left").select(
        "row",
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )
