"""Aggregates over the animals of a herd at each time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.quantile import medians, with_medians
from tracelab.functions.scan import runs
from tracelab.operators.grid import common_grid


def herd_series(trace: DataFrame) -> DataFrame:
    """Mean and exact median over animals per time, nulls skipped."""
    agg = trace.groupBy("ts").agg(F.avg("value").alias("mean"), F.count("value").alias("animals"))
    return with_medians(agg, trace, ["ts"], {"median": "value"})


def herd_series_positive(trace: DataFrame) -> DataFrame:
    """Older rule: mean of positive values, median with missing as zero, mean signal and battery."""
    agg = trace.groupBy("ts").agg(
        F.avg(F.when(F.col("value") > 0, F.col("value"))).alias("mean"),
        F.avg("signal_strength").alias("signal_strength"),
        F.avg("battery_voltage").alias("battery_voltage"),
    )
    return with_medians(agg, trace, ["ts"], {"median": F.coalesce("value", F.lit(0.0))})


def herd_rollup(df: DataFrame, bucket: Column, columns: Sequence[str]) -> DataFrame:
    """Mean of scores or predictions over animals per time bucket."""
    return df.groupBy(bucket.alias("bucket")).agg(*[F.avg(c).alias(c) for c in columns])


def herd_ratio(cells: DataFrame, *, sample: str = "sample_id", herd: str = "herd", value: str = "value") -> DataFrame:
    """Scale each usable cell by the sample's median herd/value ratio.

    The median runs over the distinct ratios of the whole window, where an unusable cell counts
    as the ratio 0.
    """
    usable = F.col(value).isNotNull() & (F.col(value) != 0) & F.col(herd).isNotNull()
    rated = cells.withColumn("_ratio", F.when(usable, F.col(herd) / F.col(value)).otherwise(F.lit(0.0)))
    factor = medians(rated.select(sample, "_ratio").distinct(), [sample], "_ratio", "_factor")
    out = rated.join(factor, sample, "left")
    scaled = F.when(usable, F.col(value) * F.abs("_factor")).otherwise(F.col(value))
    return out.withColumn("scaled", scaled).drop("_ratio", "_factor")


def herd_difference(cells: DataFrame, *, herd: str = "herd", value: str = "value") -> DataFrame:
    """Dashboard form: difference to the herd instead of a ratio."""
    return cells.withColumn("difference", F.col(value) - F.col(herd))


def drop_quiet_stretches(trace: DataFrame, step: str, longest: int) -> DataFrame:
    """Times of the herd grid with the number of animals seen, without all-null runs over ``longest``."""
    seen = trace.groupBy("ts").agg(F.count("value").alias("seen"))
    edges = seen.groupBy().agg(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi")).alias("e")).scalar()
    whole = common_grid(seen.withColumn("herd", F.lit(0)), step, series="herd")
    times = whole.withColumn("_e", edges).filter(F.col("ts").between(F.col("_e.lo"), F.col("_e.hi")))
    times = times.select("herd", "ts", "pos", F.coalesce("seen", F.lit(0)).alias("seen"))
    marked = runs(times, ["herd"], "pos", F.col("seen") == 0, 1440)
    quiet = (F.col("seen") == 0) & (F.col("run_len") > longest)
    return marked.filter(~quiet).select("ts", "seen")
