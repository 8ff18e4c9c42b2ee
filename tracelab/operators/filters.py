"""Row and cell predicates on records, traces, windows and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.quantile import let

# fixed value: highest plausible activity count of a minute
MAX_COUNT = 480


def plausible(df: DataFrame, ceiling: float = MAX_COUNT, value: str = "value") -> DataFrame:
    """Keep ``0 <= value <= ceiling`` (B1)."""
    return df.filter(F.col(value).between(0, ceiling))


def rejected_counts(df: DataFrame, ceiling: float = MAX_COUNT, value: str = "value") -> DataFrame:
    """How many records the range filter rejects, by reason (B1)."""
    v = F.col(value)
    return df.groupBy().agg(
        F.count_if(v < 0).alias("negative"), F.count_if(v > ceiling).alias("above"), F.count(F.lit(1)).alias("total")
    )


def only_station(df: DataFrame, station: Column, year: int, ts: str = "ts") -> DataFrame:
    """Station and year equality; the year is a time range so that it reaches the file scan (B2)."""
    start, stop = F.lit(f"{year}-01-01").cast("timestamp"), F.lit(f"{year + 1}-01-01").cast("timestamp")
    return df.filter(station & (F.col(ts) >= start) & (F.col(ts) < stop))


def between_times(df: DataFrame, start: str, stop: str, ts: str = "ts") -> DataFrame:
    """Time slice, both ends included."""
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(stop).cast("timestamp")))


def after_date(df: DataFrame, date: str, column: str) -> DataFrame:
    """Strictly after a date."""
    return df.filter(F.to_date(column) > F.lit(date).cast("date"))


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Keep the listed individuals."""
    return df.join(ids.select(key), key, "left_semi")


def ignore_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Leave the listed individuals out."""
    return df.join(ids.select(key), key, "left_anti")


def at_most_imputed(df: DataFrame, k: int, column: str = "imputed_days") -> DataFrame:
    """Known and at most ``k`` imputed days."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) <= k))


def varied(df: DataFrame, more_than: int = 10, features: str = "features") -> DataFrame:
    """More than ``more_than`` distinct feature values."""
    known = F.filter(features, lambda x: x.isNotNull())
    return df.filter(F.size(F.array_distinct(known)) > more_than)


def not_all_null(df: DataFrame, features: str = "features") -> DataFrame:
    """Drop samples without any value."""
    return df.filter(~F.forall(features, lambda x: x.isNull()))


def no_nulls(df: DataFrame, features: str = "features") -> DataFrame:
    """Drop samples with any null."""
    return df.filter(~F.exists(features, lambda x: x.isNull()))


def clip_negative(features: str | Column = "features") -> Column:
    """Negative cells become 0; nulls stay."""
    return F.transform(features, lambda x: F.when(x < 0, F.lit(0.0)).otherwise(x))


def fill_null(constant: float, features: str | Column = "features") -> Column:
    """Null cells become a constant."""
    return F.transform(features, lambda x: F.coalesce(x, F.lit(float(constant))))


def only_classes(df: DataFrame, classes: Sequence[int], column: str = "health") -> DataFrame:
    """Keep the listed classes."""
    return df.filter(F.col(column).isin(*classes))


def good_traces(df: DataFrame, threshold: int) -> DataFrame:
    """Series with at least ``threshold`` records and as many zero records."""
    good = df.groupBy("series_id").agg(F.count("value").alias("_c"), F.count_if(F.col("value") == 0).alias("_z"))
    good = good.filter((F.col("_c") >= threshold) & (F.col("_z") >= threshold)).select("series_id")
    return df.join(good, "series_id", "left_semi")


def window_quality(df: DataFrame, width: int) -> DataFrame:
    """Per ``(series_id, window)`` of ``width`` cells: null share, sum, positives, zeros, size."""
    return df.groupBy("series_id", F.floor(F.col("pos") / width).alias("window")).agg(
        F.avg(F.col("value").isNull().cast("double")).alias("null_ratio"),
        F.sum("value").alias("total"),
        F.count_if(F.col("value") > 0).alias("positive"),
        F.count_if(F.col("value") == 0).alias("zeros"),
        F.count(F.lit(1)).alias("cells"),
    )


def good_windows(df: DataFrame, width: int, null_ratio: float, at_least: float) -> DataFrame:
    """Windows with few nulls and enough activity."""
    return window_quality(df, width).filter(
        (F.col("null_ratio") <= null_ratio) & (F.coalesce("total", F.lit(0.0)) >= at_least)
    )


def active_windows(df: DataFrame, width: int, positive: int = 100) -> DataFrame:
    """Windows that are not zero throughout and hold more than ``positive`` positive cells (B18); a null is not zero."""
    quality = window_quality(df, width)
    return quality.filter((F.col("zeros") < F.col("cells")) & (F.col("positive") > positive))


def day_quality(df: DataFrame) -> DataFrame:
    """Per ``(series_id, day)``: cells and nulls."""
    return df.groupBy("series_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("value").isNull()).alias("nulls")
    )


def days_by_nulls(df: DataFrame, cells: int, at_least: int) -> DataFrame:
    """Whole days with at least ``at_least`` nulls."""
    return day_quality(df).filter((F.col("cells") == cells) & (F.col("nulls") >= at_least))


def complete_days(df: DataFrame, cells: int) -> DataFrame:
    """Whole days without a null."""
    return day_quality(df).filter((F.col("cells") == cells) & (F.col("nulls") == 0))


def sample_validity(length: Column, expected: int, nulls: Column, score: Column, previous: Column) -> Column:
    """Why a sample is unusable; null when it is valid."""
    return (
        F.when(length != expected, "length")
        .when(nulls > 0, "null cells")
        .when(score.isNull(), "no score")
        .when(previous.isNull(), "no previous score")
    )


def append_features(extra: Sequence[Column], features: str | Column = "features") -> Column:
    """Features followed by extra scalar columns."""
    base = F.col(features) if isinstance(features, str) else features
    return F.concat(base, F.array(*[c.cast("double") for c in extra]))


def drop_empty_positions(df: DataFrame) -> DataFrame:
    """Remove positions that are null in every sample.

    The list of live positions is one short array, bounded by the sample width.
    """
    cells = df.select(F.posexplode("features").alias("pos", "x"))
    live = cells.groupBy("pos").agg(F.count("x").alias("c")).filter(F.col("c") > 0)
    positions = live.groupBy().agg(F.sort_array(F.collect_list("pos")).alias("l")).scalar()
    return df.withColumn("_live", positions).withColumn(
        "features", let(F.col("features"), lambda f: F.transform("_live", lambda p: F.get(f, p)))
    ).drop("_live")
