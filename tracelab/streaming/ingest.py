"""The cleaning and roll-up steps on a stream of records.

The batch operators are plain filters and aggregates, so a stream passes through the same rules;
only duplicates and closed windows need a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.operators.filters import MAX_COUNT, plausible


def clean_stream(records: DataFrame, *, late: str = "2 hours", ceiling: float = MAX_COUNT) -> DataFrame:
    """Range filter and removal of repeated ``(series_id, ts, value)`` records within the lateness."""
    kept = plausible(records, ceiling).withWatermark("ts", late)
    return kept.dropDuplicatesWithinWatermark(["series_id", "ts", "value"])


def rollup_stream(clean: DataFrame, width: str = "1 hour") -> DataFrame:
    """Sum, count and extremes per series and window; a window is final once the watermark passes it."""
    return (
        clean.groupBy("series_id", F.window("ts", width).alias("w"))
        .agg(
            F.sum("value").alias("value"),
            F.count("value").alias("n"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
        .select("series_id", F.col("w.start").alias("bucket"), "value", "n", "low", "high")
    )
