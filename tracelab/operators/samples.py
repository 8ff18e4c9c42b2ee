"""Labelled fixed-length samples cut in front of each visit, and window slicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.quantile import let
from tracelab.functions.scan import neighbours
from tracelab.operators.filters import sample_validity
from tracelab.operators.grid import seconds
from tracelab.operators.labels import transition
from tracelab.session import materialise


def visit_spans(visits: DataFrame, step: str, days: int, shift_days: int = 0) -> DataFrame:
    """The half-open window ``(visit - days, visit]`` on the grid step, optionally shifted back."""
    n = seconds(step)
    stop = F.floor(F.unix_seconds("visit_ts") / n) * n - shift_days * 86400
    return visits.withColumns(
        {"stop": F.timestamp_seconds(stop), "start": F.timestamp_seconds(stop - days * 86400)}
    )


def _windows(trace: DataFrame, spans: DataFrame, step: str, days: int) -> DataFrame:
    """The columns of ``spans`` and, as ``_cells``, the trace cells of its series in ``(start, stop]``, ordered by time; spans without a cell may be absent.

    Time is cut into stretches as long as a window, so that a window lies in two of them.  Each stretch is one row that also holds the stretch
    before it; a window meets the row of its end and is a slice of it, so no cell is joined or shuffled per window.
    """
    n, width = seconds(step), days * 86400
    stretch = F.floor(F.unix_seconds("ts") / width)
    cell = F.struct("ts", *[c for c in trace.columns if c not in ("series_id", "ts")]).alias("_cell")
    held = trace.filter(F.col("ts").isNotNull() & F.col("series_id").isNotNull()).select("series_id", cell, F.explode(F.array(stretch, stretch + 1)).alias("_stretch"))
    held = held.groupBy("series_id", "_stretch").agg(F.sort_array(F.collect_list("_cell")).alias("_held"))
    first, last = F.unix_seconds(F.get("_held", F.lit(0))["ts"]), F.unix_seconds(F.element_at("_held", -1)["ts"])
    # where a stretch has no hole, a cell's place follows from its time
    held = held.withColumn("_first", F.when(last - first == (F.size("_held") - 1) * n, first))
    place = lambda ts: F.floor((F.unix_seconds(ts) - F.col("_first")) / n)
    after = F.greatest(place("start") + 1, F.lit(0))
    sliced = F.slice("_held", (after + 1).cast("int"), F.greatest(place("stop") - after + 1, F.lit(0)).cast("int"))
    sought = F.filter("_held", lambda c: (c["ts"] > F.col("start")) & (c["ts"] <= F.col("stop")))
    met = spans.withColumn("_stretch", F.floor(F.unix_seconds("stop") / width)).join(held, ["series_id", "_stretch"])
    return met.select(*spans.columns, F.when(F.col("_first").isNotNull(), sliced).otherwise(sought).alias("_cells"))


def sample_cells(trace: DataFrame, visits: DataFrame, step: str, days: int) -> DataFrame:
    """``(visit_id, pos, value, imputed)`` for every cell of every visit's window.

    ``trace`` has at most one row per ``(series_id, ts)`` on the step.  Windows are cut out of stretches of the trace, so no key is joined whole.
    """
    spans = visit_spans(visits, step, days).select("series_id", "visit_id", "start", "stop")
    hits = _windows(trace, spans, step, days).select("series_id", "visit_id", "start", "stop", F.inline("_cells"))
    pos = F.floor((F.unix_seconds("ts") - F.unix_seconds("start")) / seconds(step) - 1)
    own = [pos.alias("pos") if c == "pos" else F.col(c) for c in trace.columns]
    return hits.select(*own, "visit_id", "start", "stop", *([] if "pos" in trace.columns else [pos.alias("pos")]))


def previous_score(visits: DataFrame) -> DataFrame:
    """Score of the visit before, ordered by time, and the transition label."""
    out = neighbours(
        visits,
        ["series_id"],
        ["visit_ts", "visit_id"],
        F.date_trunc("month", "visit_ts"),
        {"prev_score": (F.col("score"), 1)},
    )
    return out.withColumn("label", transition(F.col("prev_score"), F.col("score")))


def labelled_samples(trace: DataFrame, visits: DataFrame, step: str, days: int) -> DataFrame:
    """One row per visit that has a previous score and a full window of trace cells (M1).

    ``imputed_days`` counts days whose every cell carries the imputed flag, ``complete_days``
    days without a null; a sample is valid with at least one imputed-flagged day and one value.
    Rows that share a visit id share one window, of all their cells together; these few are looked for first and grouped by themselves.
    """
    day_cells = 86400 // seconds(step)
    labelled = previous_score(visits).filter(F.col("prev_score").isNotNull() & F.col("visit_id").isNotNull())
    shared = visits.groupBy("visit_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND visit_id IS NOT NULL").select("visit_id")
    shared = materialise(shared, "shared-visits")
    alone = labelled.select("series_id", "visit_ts", F.struct(*labelled.columns).alias("_visit"))
    few = not shared.isEmpty()
    if few:
        alone = alone.join(shared, F.col("_visit.visit_id") == shared["visit_id"], "left_anti")
    spans = visit_spans(alone, step, days).select("series_id", "start", "stop", "_visit")
    trace = trace.select("series_id", "ts", "value", "imputed")
    found = _windows(trace, spans, step, days).select("_visit", "_cells")
    if few:
        cells = sample_cells(trace, visits.join(shared, "visit_id", "left_semi"), step, days)
        body = cells.groupBy("visit_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value", "imputed"))).alias("_cells"))
        body = body.select("visit_id", F.transform("_cells", lambda c: F.struct(F.lit(None).cast("timestamp").alias("ts"), c["value"].alias("value"), c["imputed"].alias("imputed"))).alias("_cells"))
        again = labelled.join(shared, "visit_id", "left_semi").select("visit_id", F.struct(*labelled.columns).alias("_visit"))
        found = found.unionByName(again.join(body, "visit_id").select("_visit", "_cells"))
    found = found.filter(F.size("_cells") == days * day_cells)
    each_day = F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda d: F.slice("_cells", d * day_cells + 1, F.lit(day_cells)))
    flags = let(each_day, lambda parts: F.struct(
        F.size(F.filter(parts, lambda day: F.forall(day, lambda c: c["imputed"] == 1))).cast("long").alias("imputed_days"),
        F.size(F.filter(parts, lambda day: F.forall(day, lambda c: c["value"].isNotNull()))).cast("long").alias("complete_days"),
    ))
    body = found.select("_visit", F.col("_cells.value").alias("features"), flags.alias("_f"))
    out = body.select(
        F.col("_visit.visit_id").alias("sample_id"), *[F.col(f"_visit.{c}").alias(c) for c in labelled.columns if c != "visit_id"],
        F.size("features").cast("long").alias("cells"), F.size(F.array_compact("features")).cast("long").alias("seen"), "features", "_f.imputed_days", "_f.complete_days",
    )
    return out.withColumn("valid", (F.col("imputed_days") >= 1) & (F.col("seen") > 0))


def sample_report(cells: DataFrame, visits: DataFrame, expected: int) -> DataFrame:
    """Validity of each visit's sample with the reason."""
    body = cells.groupBy("visit_id").agg(
        F.count(F.lit(1)).alias("length"), F.count_if(F.col("value").isNull()).alias("nulls")
    )
    out = previous_score(visits).join(body, "visit_id", "left").fillna(0, ["length", "nulls"])
    reason = sample_validity(F.col("length"), expected, F.col("nulls"), F.col("score"), F.col("prev_score"))
    return out.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


def expected_length(resolution: Column, days: Column) -> Column:
    """Cells of a window of ``days`` at a resolution, both ends counted."""
    # fixed values: cells of a day at each resolution
    per_day = (
        F.when(resolution == "min", 1440)
        .when(resolution == "5min", 288)
        .when(resolution == "10min", 144)
        .when(resolution == "hour", 24)
        .when(resolution == "day", 1)
    )
    return per_day * days + 1


def rolling_windows(df: DataFrame, width: int, stride: int, features: str = "features") -> DataFrame:
    """Every ``width`` cells, ``stride`` apart, as rows."""
    last = F.size(features) - width
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride)))
    return df.withColumn("start", F.explode(starts)).withColumn(
        features, F.slice(features, F.col("start") + 1, F.lit(width))
    )


def recent_days(df: DataFrame, days: int, day_cells: int, features: str = "features") -> DataFrame:
    """Only the most recent ``days`` of each sample."""
    n = days * day_cells
    return df.withColumn(features, F.slice(features, F.greatest(F.size(features) - n, F.lit(0)) + 1, F.lit(n)))


def sum_bins(k: int, features: str | Column = "features") -> Column:
    """Sums of ``k`` neighbouring cells; nulls are skipped, an all-null bin is null."""
    arr = F.col(features) if isinstance(features, str) else features
    starts = F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / k).cast("int"))

    def total(i: Column) -> Column:
        kept = F.filter(F.slice(arr, i * k + 1, F.lit(k)), lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x))

    return F.transform(starts, total)


def pad_to(length: int, features: str | Column = "features", filler: float = -1.0) -> Column:
    """Right-pad to a fixed length."""
    arr = F.col(features) if isinstance(features, str) else features
    return F.concat(arr, F.array_repeat(F.lit(filler), F.greatest(F.lit(length) - F.size(arr), F.lit(0))))


def jitter(df: DataFrame, n: int, features: str = "features") -> DataFrame:
    """Copies of each sample shifted by ±1 … ±(n/2 − 1) cells and cropped (M9)."""
    crop = n // 2
    shifts = F.array(*[F.lit(s) for i in range(1, crop) for s in (-i, i)])
    width = F.size(features) - 2 * crop
    return df.withColumn("shift", F.explode(shifts)).withColumn(
        features, F.slice(features, F.col("shift") + crop + 1, width)
    )
