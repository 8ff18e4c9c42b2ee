"""Document fingerprints: a sketch scaled by a threshold.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so that its size follows the text's and two sketches
of very different size still tell how much of the smaller one the larger one holds.  Sketches of parts merge by union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.quantile import let
from tracelab.llm.common import identified, shingle_hashes
from tracelab.session import materialise

FRACTION = 1 / 8
SHINGLE = 5
SPREAD = 64  # stretches for rows without an id


def threshold(fraction: float) -> int:
    """Hashes are signed: the kept fraction lies below this value."""
    return -(2**63) + int(fraction * 2**64)


def sketch(text: Column, size: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """Sorted distinct shingle hashes below the threshold.

    A text none of whose hashes is below it keeps its least hash, so that only texts without words have an empty sketch.
    """

    def kept(hashes: Column) -> Column:
        low = F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < threshold(fraction))))
        return let(low, lambda l: F.when((F.size(l) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(l))

    return let(shingle_hashes(text, size), kept)


def written(hashes: Column) -> Column:
    """A sketch as text."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles that the other one holds; empty texts are alike."""
    least = F.least(F.size(a), F.size(b))
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """``(row, sketch)``: one row per input row, ``row`` holding all its columns.

    A null or empty text, or one of blanks only, has an empty sketch; a text of fewer than ``size`` words is one shingle.  Equal texts
    have equal sketches, repeated rows included.  An empty table gives an empty result.
    """
    return identified(docs, id_col, text_col).select("row", sketch(F.col("text"), size, fraction).alias("sketch"))


def merged(sketches: DataFrame, key: str, hashes: str = "sketch", *, fraction: float = FRACTION) -> DataFrame:
    """``(key, hash)``: the sketch of all texts of a key together, one row per hash, since a key may be as large as the corpus."""
    each = sketches.select(F.col(key), F.explode(hashes).alias("hash"))
    low = F.col("hash") < threshold(fraction)
    blank = each.groupBy(key).agg(F.min("hash").alias("hash")).where(~low)
    return each.where(low).distinct().unionByName(blank)


def _in_stretches(base: DataFrame) -> DataFrame:
    """``(bucket, key, fp, text)``, dealt by ``bucket``: ids in stretches that a sketch of them makes about even; rows without an id in ``SPREAD`` below 0.

    This is the only time that texts are shuffled.
    """
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.array(*[F.lit(i / parts) for i in range(1, max(parts, 2))])
    bounds = base.where(F.col("id").isNotNull()).agg(F.approx_percentile("id", cuts, F.lit(10_000)).alias("b"))
    bucket = F.when(F.col("id").isNull(), -1 - F.pmod("fp", F.lit(SPREAD))).otherwise(F.size(F.filter("_b", lambda b: b < F.col("id"))).cast("long"))
    placed = base.withColumn("_b", F.coalesce(bounds.scalar(), F.array().cast("array<bigint>")))
    return placed.select(bucket.alias("bucket"), F.coalesce("id", F.lit(0)).alias("key"), "fp", "text").repartition("bucket")


def _with_next(base: DataFrame, size: int, fraction: float) -> DataFrame:
    """``(id, text, sketch, next)``: each row with text and sketch of the next smaller id; the smallest id is followed by no id or else the largest.

    Inside a stretch it is the nearest row below that gives; a row that stands last of its id, with the smallest fingerprint, gives.  The lowest id
    of a stretch looks up the giver of the stretch below, of which there is one per stretch.
    """
    placed = _in_stretches(base)
    rising = Window.partitionBy("bucket").orderBy("key", F.col("fp").desc())
    onward = F.lead("key").over(rising)
    own = F.when(F.col("bucket") >= 0, F.col("key")).alias("id")

    def followed(rows: DataFrame, giver: Column) -> DataFrame:
        marked = rows.withColumn("_to", onward)
        gives = F.when(F.col("_to").isNull() | (F.col("_to") != F.col("key")), giver)
        return marked.withColumn("next", F.last(gives, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, -1)))

    sketched = placed.withColumn("sketch", sketch(F.col("text"), size, fraction))
    inside = followed(sketched, F.struct("text", "sketch")).where(F.col("next").isNotNull()).select(own, "text", "sketch", "next")
    # the few rows without a giver in their stretch
    lowest = followed(placed, F.lit(True)).where(F.col("next").isNull()).select("bucket", "key", "text")
    group = F.greatest(F.col("bucket"), F.lit(-1).cast("long"))
    heads = placed.withColumn("_to", onward).where(F.col("_to").isNull())
    heads = heads.groupBy(group.alias("below")).agg(F.min_by("text", "fp").alias("text"))
    heads = materialise(heads.select("below", F.struct("text", sketch(F.col("text"), size, fraction).alias("sketch")).alias("next")), "stretch-heads")
    everywhere = Window.orderBy("below")  # as many rows as stretches
    wrapped = F.max("below").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    order = heads.select(F.col("below").alias("at"), F.coalesce(F.lag("below").over(everywhere), wrapped).alias("below"))
    border = lowest.withColumn("at", group).join(order, "at").join(heads, "below").select(own, "text", sketch(F.col("text"), size, fraction).alias("sketch"), "next")
    return inside.unionByName(border)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.  The edited text has its last third
    replaced by as many code points (or all) from the start of the text with the next smaller id; the smallest id is followed by the
    largest, null ids come last.  Rows that share an id each have their own result and the same next text; of several texts with the next
    id, the one with the smallest fingerprint gives.  A null text is empty; an only document follows itself.  An empty table gives an
    empty result; extra columns are not carried.
    """
    both = _with_next(identified(docs, id_col, text_col).select("id", "fp", "text"), size, fraction)
    both = both.withColumn("n_chars", F.char_length("text")).withColumn("third", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, n_chars - third)"), F.expr("substring(next.text, 1, third)"))
    both = both.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), size, fraction))
    return both.select(
        "id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next.sketch")).alias("near_next"),
    )
