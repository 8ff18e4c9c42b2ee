"""The corpus pipeline: reject poor texts, drop shared lines, keep one of each group of near copies, drop benchmark passages, encode.

Every stage reads what the one before kept and returns the columns of ``documents``; the last one returns the encoded corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm import decontamination, jaccard_join, line_dedup, piece_encoding, quality
from tracelab.llm.common import identified, restored
from tracelab.llm.queries import table, tokenizer
from tracelab.session import configure, materialise

ORACLE_SQL = None  # the classifier and the encoder are beyond SQL


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: shared lines go from all documents but the first; ``n_chars`` follows the text."""
    out = line_dedup.drop_repeated_lines(docs)
    return restored(out, docs, text=F.col("kept"), n_chars=F.char_length("kept").cast("long"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles at 0.8: of each component one document stays, once.

    It is the one of the smallest id, nulls last, and among texts of one id that of the smallest fingerprint; texts without words all stay.
    """
    near = jaccard_join.representatives(docs, size=5, percent=80)
    stay = materialise(near, "representatives").withColumnsRenamed({"id": "s_id", "fp": "s_fp"})
    base = identified(docs)
    left = base.join(stay, base["id"].eqNullSafe(stay["s_id"]) & (base["fp"] == stay["s_fp"])).select("id", "fp", "row", "n")
    return restored(left.where("n = 1").unionByName(left.where("n > 1").dropDuplicates(["id", "fp"])), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a passage of the benchmark go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece encoding: ids of every text, with the hashes of ids and of the decoded text."""
    out = piece_encoding.encode_decode(docs, tokenizer("piece_bpe_32k.model"), keep=("ids",))
    return out.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", reject_poor),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_one),
    ("benchmark decontamination", drop_leaks),
    ("piece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
