"""Regular grids, roll-ups to a resolution, collision back-fill and block reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
DAY = 86400
RESOLUTIONS = ("5 minutes", "10 minutes", "hour", "day", "week", "month")


def seconds(step: str) -> int:
    """``'5 minutes'`` → 300."""
    n, unit = step.split()
    return int(n) * UNITS[unit.rstrip("s")]


def floor_ts(ts: Column, step: str) -> Column:
    """Start of the fixed-width step that holds ``ts``."""
    n = seconds(step)
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / n) * n)


def bucket_of(ts: Column, resolution: str) -> Column:
    """Bucket start for a resolution name: calendar units, or a fixed number of minutes."""
    if resolution in ("minute", "hour", "day", "week", "month"):
        return F.date_trunc(resolution, ts)
    return floor_ts(ts, resolution)


def day_of(ts: str = "ts") -> Column:
    """Monotone bucket for ordered scans over time: the UTC day number."""
    return F.floor(F.unix_seconds(F.col(ts)) / DAY)


def bucket_sum(df: DataFrame, step: str, *, series: str = "series_id", ts: str = "ts", value: str = "value"):
    """Sum per series and step; a bucket whose values are all null stays null."""
    return df.groupBy(series, floor_ts(F.col(ts), step).alias("ts")).agg(F.sum(value).alias("value"))


def _steps(lo: Column, hi: Column, step: int) -> tuple[Column, int]:
    chunk = step * max(1, DAY // step)
    return F.sequence(lo, hi, F.lit(chunk).cast("long")), chunk


def expand_steps(spans: DataFrame, step: str, *keep: str) -> DataFrame:
    """``(lo, hi)`` in epoch seconds → one row per step.

    Two explodes (days, then steps of a day) keep every generated array short.
    """
    n = seconds(step)
    days, chunk = _steps(F.col("lo"), F.col("hi"), n)
    chunks = spans.select(*keep, "lo", "hi", F.explode(days).alias("_from"))
    stop = F.least(F.col("_from") + F.lit(chunk - n), F.col("hi"))
    at = F.explode(F.sequence(F.col("_from"), stop, F.lit(n).cast("long")))
    return chunks.select(*keep, "lo", at.alias("_at")).select(
        *keep,
        F.timestamp_seconds("_at").alias("ts"),
        F.floor((F.col("_at") - F.col("lo")) / n).alias("pos"),
    )


def on_grid(spans: DataFrame, df: DataFrame, step: str, series: str) -> DataFrame:
    """Every step of ``(series, lo, hi)`` with the rows of ``df`` at that time, or nulls.

    Stretches of up to 24 steps meet the rows of their time as one list, and are written out as steps afterwards: no single step is shuffled.
    """
    n = seconds(step)
    size = n * max(1, min(24, DAY // n))
    part = lambda c: F.floor(c / F.lit(size))
    far = F.explode(F.sequence(F.floor(part(F.col("lo")) / 1024), F.floor(part(F.col("hi")) / 1024)))
    near = F.sequence(F.greatest(F.col("_far") * 1024, part(F.col("lo"))), F.least(F.col("_far") * 1024 + 1023, part(F.col("hi"))))
    parts = spans.select(series, "lo", "hi", far.alias("_far")).select(series, "lo", "hi", F.explode(near).alias("_part"))
    rest = [c for c in df.columns if c not in (series, "ts")]
    held = df.groupBy(series, part(F.unix_seconds("ts")).alias("_part")).agg(F.collect_list(F.struct("ts", *rest)).alias("_rows"))
    first = F.greatest(F.col("lo"), F.col("lo") + F.ceil((F.col("_part") * size - F.col("lo")) / n) * n)
    last = F.least(F.col("hi"), F.col("_part") * size + (size - 1))
    at = F.when(first <= last, F.sequence(first, last, F.lit(n).cast("long")))

    steps = parts.join(held, [series, "_part"], "left").select(series, "lo", "_rows", F.explode(at).alias("_t"))
    when = F.timestamp_seconds("_t")
    found = F.filter("_rows", lambda r: r["ts"] == when)
    named = steps.select(series, when.alias("_at"), F.floor((F.col("_t") - F.col("lo")) / n).alias("pos"), F.inline_outer(found))
    return named.select(series, F.col("_at").alias("ts"), "pos", *rest)


def regular_grid(df: DataFrame, step: str, *, series: str = "series_id") -> DataFrame:
    """Every step from a series' first to its last record; absent steps are null.

    ``df`` holds at most one row per ``(series, ts)`` with ``ts`` on the step.
    """
    spans = df.groupBy(series).agg(
        F.min(F.unix_seconds("ts")).alias("lo"), F.max(F.unix_seconds("ts")).alias("hi")
    )
    return on_grid(spans, df, step, series)


def common_grid(df: DataFrame, step: str, *, ids: DataFrame | None = None, series: str = "series_id") -> DataFrame:
    """One grid for the whole herd: first day to the end of the last day, both ends included.

    ``ids`` may name animals without any record; they get an all-null trace.
    """
    day = F.floor(F.unix_seconds("ts") / DAY) * DAY
    edges = df.groupBy().agg(F.struct(F.min(day).alias("lo"), (F.max(day) + DAY).alias("hi")).alias("e")).scalar()
    who = (ids if ids is not None else df).select(series).distinct()
    spans = who.withColumns({"lo": edges.getField("lo"), "hi": edges.getField("hi")})
    return on_grid(spans, df, step, series)


def drop_duplicate_records(df: DataFrame, *, series: str = "series_id", ts: str = "ts", value: str = "value"):
    """One record per ``(series, ts, value)`` (T5)."""
    return df.dropDuplicates([series, ts, value])


def backfill_collisions(df: DataFrame, step: str, *, series: str = "series_id", ts: str = "ts", tie: str) -> DataFrame:
    """At most one record per step; colliding records move to the latest free earlier step.

    Going back in time, the r-th record gets the smallest ``bin + rank`` so far, minus its
    rank: that is the latest slot that is free and not later than its own step.
    """
    n = seconds(step)
    keys = [series, "_day"]
    back, last_first = F.unix_micros(ts).desc(), F.col(tie).desc()
    local = Window.partitionBy(*keys).orderBy(back, last_first)
    placed = df.withColumns({"bin": F.floor(F.unix_seconds(ts) / n), "_day": F.floor(F.unix_seconds(ts) / DAY)})
    # rank and running minimum inside the day; a day's rows and minimum shift those of earlier days
    placed = placed.withColumn("_r", F.row_number().over(local))
    placed = placed.withColumn("_low", F.min(F.col("bin") + F.col("_r")).over(local))
    later = Window.partitionBy(series).orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.col("bin") + F.col("_r")).alias("_m"))
    days = days.withColumn("_shift", F.coalesce(F.sum("_n").over(later), F.lit(0)))
    days = days.withColumn("_lower", F.min(F.col("_m") + F.col("_shift")).over(later)).drop("_n", "_m")
    low = F.least(F.col("_low") + F.col("_shift"), F.col("_lower"))
    return (
        placed.join(days, keys)
        .withColumn("slot", low - F.col("_shift") - F.col("_r"))
        .withColumn("slot_ts", F.timestamp_seconds(F.col("slot") * n))
        .drop("_day", "_r", "_low", "_shift", "_lower")
    )


def simple_resample(df: DataFrame, step: str) -> DataFrame:
    """First/min/max/mean/sum per step on the series' grid; steps without a record are null (T4)."""
    agg = df.groupBy("series_id", floor_ts(F.col("ts"), step).alias("ts")).agg(
        F.sum("value").alias("value"),
        F.min("signal_strength").alias("signal_min"),
        F.max("signal_strength").alias("signal_max"),
        F.avg("battery_voltage").alias("battery"),
        F.min_by("serial_ts", "serial_ts").alias("first_ts"),
    )
    return regular_grid(agg, step)


def resample(df: DataFrame, resolution: str) -> DataFrame:
    """Roll raw records up to a resolution (D3)."""
    return finish_rollup(partial_rollup(df, resolution))


def partial_rollup(df: DataFrame, resolution: str) -> DataFrame:
    """Mergeable roll-up state: sums and counts instead of means."""
    return df.groupBy("series_id", bucket_of(F.col("ts"), resolution).alias("bucket")).agg(
        F.sum("value").alias("value"),
        F.min("signal_strength").alias("signal_min"),
        F.max("signal_strength").alias("signal_max"),
        F.sum("battery_voltage").alias("_bsum"),
        F.count("battery_voltage").alias("_bcount"),
        F.min("ts").alias("first_ts"),
    )


def merge_rollup(partial: DataFrame, resolution: str) -> DataFrame:
    """Coarser state from finer state."""
    return partial.groupBy("series_id", bucket_of(F.col("bucket"), resolution).alias("bucket")).agg(
        F.sum("value").alias("value"),
        F.min("signal_min").alias("signal_min"),
        F.max("signal_max").alias("signal_max"),
        F.sum("_bsum").alias("_bsum"),
        F.sum("_bcount").alias("_bcount"),
        F.min("first_ts").alias("first_ts"),
    )


def finish_rollup(partial: DataFrame) -> DataFrame:
    return partial.withColumn("battery", F.try_divide("_bsum", "_bcount")).drop("_bsum", "_bcount")


def rollups(df: DataFrame, resolutions: Sequence[str] = RESOLUTIONS) -> DataFrame:
    """All resolutions in one table; only the finest reads the raw records."""
    finest, *coarser = resolutions
    parts = [(finest, partial_rollup(df, finest))]
    day: DataFrame | None = None
    for name in coarser:
        source = day if day is not None else parts[-1][1]
        parts.append((name, merge_rollup(source, name)))
        if name == "day":
            day = parts[-1][1]
    out = None
    for name, part in parts:
        part = finish_rollup(part).withColumn("resolution", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def resample_from_first(df: DataFrame, step: str) -> DataFrame:
    """Older roll-up rule: buckets count from the series' first record, battery is a minimum."""
    n = seconds(step)
    first = df.groupBy("series_id").agg(F.min(F.unix_seconds("ts")).alias("lo"))
    joined = df.join(first, "series_id")
    start = F.col("lo") + F.floor((F.unix_seconds("ts") - F.col("lo")) / n) * n
    return joined.groupBy("series_id", start.alias("bucket_s")).agg(
        F.sum("value").alias("value"),
        F.max("signal_strength").alias("signal_max"),
        F.min("signal_strength").alias("signal_min"),
        F.min("battery_voltage").alias("battery_min"),
    )


def resample_from_first_filled(df: DataFrame, step: str) -> DataFrame:
    """The older roll-up with a row for every step from a series' first to its last record; steps without a record are null."""
    n = seconds(step)
    found = resample_from_first(df, step)
    spans = found.groupBy("series_id").agg(F.min("bucket_s").alias("lo"), F.max("bucket_s").alias("hi"))
    placed = on_grid(spans, found.withColumn("ts", F.timestamp_seconds("bucket_s")).drop("bucket_s"), step, "series_id")
    return placed.select("series_id", F.unix_seconds("ts").alias("bucket_s"), *[c for c in found.columns if c not in ("series_id", "bucket_s")])


def sliding_sums(df: DataFrame, width: str, stride: str) -> DataFrame:
    """``(series_id, start, n, total)``: count and sum of a series' records in every window of ``width`` that begins on a ``stride``."""
    found = df.groupBy("series_id", F.window("ts", width, stride).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select("series_id", F.col("_w.start").alias("start"), "n", "total")


def resample_with(df: DataFrame, resolution: str, how: dict[str, str]) -> DataFrame:
    """User-chosen aggregate per column: ``{column: 'sum' | 'first' | 'median' | ...}`` (K1).

    ``first`` means first in time.  Medians take the exact path for groups of any size.
    """
    from tracelab.functions.quantile import with_medians

    keyed = df.withColumn("bucket", bucket_of(F.col("ts"), resolution))
    plain = {
        "sum": F.sum,
        "min": F.min,
        "max": F.max,
        "mean": F.avg,
        "count": F.count,
        "first": lambda c: F.min_by(c, F.struct("ts", c)),
    }
    unknown = set(how.values()) - set(plain) - {"median"}
    if unknown:
        raise ValueError(f"unknown aggregate {sorted(unknown)}")
    agg = keyed.groupBy("series_id", "bucket").agg(
        F.count(F.lit(1)).alias("n"), *[plain[f](c).alias(c) for c, f in how.items() if f != "median"]
    )
    medians = {c: c for c, f in how.items() if f == "median"}
    return with_medians(agg, keyed, ["series_id", "bucket"], medians)


def shrink_to_width(df: DataFrame, width: int) -> DataFrame:
    """Sum a gridded series into at most ``width`` equal bins by position, with the bin's last time.

    One rule for series of any length: of a series shorter than ``width``, some bins stay empty.
    """
    size = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    binned = df.join(size, "series_id").withColumn("bin", F.expr(f"pos * {int(width)}L div n"))
    return binned.groupBy("series_id", "bin").agg(F.sum("value").alias("value"), F.max("ts").alias("last_ts"))


def crop_to_blocks(df: DataFrame, block: int) -> DataFrame:
    """Keep the leading whole blocks (weeks) of every gridded series."""
    size = df.groupBy("series_id").agg((F.max("pos") + 1).alias("n"))
    return df.join(size, "series_id").filter(F.col("pos") < F.floor(F.col("n") / block) * block).drop("n")


def to_blocks(df: DataFrame, block: int, *, pad: bool = False) -> DataFrame:
    """Gridded series → ``(series_id, block, values)``; arrays hold at most ``block`` cells.

    ``pad`` repeats the last value of an incomplete block up to the full width.
    """
    cells = F.array_sort(F.collect_list(F.struct("pos", "value")))
    out = df.groupBy("series_id", F.floor(F.col("pos") / block).alias("block")).agg(
        F.transform(cells, lambda c: c["value"]).alias("values")
    )
    if pad:
        missing = F.lit(block) - F.size("values")
        tail = F.array_repeat(F.element_at("values", -1), missing.cast("int"))
        out = out.withColumn("values", F.concat("values", tail))
    return out


def from_blocks(df: DataFrame, block: int) -> DataFrame:
    """Inverse of :func:`to_blocks`."""
    return df.select(
        "series_id", (F.col("block") * block).alias("_start"), F.posexplode("values").alias("_i", "value")
    ).select("series_id", (F.col("_start") + F.col("_i")).alias("pos"), "value")


def zoom_resolution(span_seconds: Column) -> Column:
    """Resolution a dashboard span is served from."""
    # fixed values: span limits in weeks
    return (
        F.when(span_seconds > 5 * UNITS["week"], "hour")
        .when(span_seconds > UNITS["week"], "10 minutes")
        .when(span_seconds > 0, "5 minutes")
        .otherwise("month")
    )
