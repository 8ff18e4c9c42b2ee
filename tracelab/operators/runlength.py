"""Traces as the cells that were recorded and the stretches between them.

A trace on a regular grid is mostly a default: no record, or a zero.  Here only cells that differ from it are rows; runs, gaps and what fills them
are computed on those rows, and the grid is written out at the very end, if at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.scan import neighbours, ranked, scan
from tracelab.operators.grid import DAY, seconds
from tracelab.operators.impute import BLOCK, KEY, gap_length, line_between, line_held, line_then_zero, near_value
from tracelab.session import materialise


@dataclass
class SparseTrace:
    """``cells``: ``(series_id, pos, value)``, one row per listed cell; ``spans``: ``(series_id, first, last)``; other cells hold ``default``."""

    cells: DataFrame
    spans: DataFrame
    default: float | None = None


def own_grid(df: DataFrame, step: str) -> SparseTrace:
    """Each series from its first to its last record (T1); ``df`` holds at most one row per ``(series_id, ts)``, on the step.

    The rows are written out once, so that what follows does not compute them again.
    """
    n = seconds(step)
    rows = materialise(df.select("series_id", F.floor(F.unix_seconds("ts") / n).alias("at"), "value"), "recorded-cells")
    ends = rows.groupBy("series_id").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    ends = materialise(ends, "series-ends")
    cells = rows.join(ends, "series_id").select("series_id", (F.col("at") - F.col("lo")).alias("pos"), "value")
    return SparseTrace(cells, ends.select("series_id", F.lit(0).cast("long").alias("first"), (F.col("hi") - F.col("lo")).alias("last")))


def herd_grid(df: DataFrame, step: str, *, ids: DataFrame | None = None) -> SparseTrace:
    """All series from the herd's first day to the end of its last (T2); ``ids`` may name animals without a record."""
    n = seconds(step)
    rows = materialise(df.select("series_id", F.unix_seconds("ts").alias("s"), "value"), "recorded-cells")
    day = F.floor(F.col("s") / DAY) * DAY
    edge = rows.groupBy().agg(F.struct(F.min(day).alias("lo"), (F.max(day) + DAY).alias("hi")).alias("e")).scalar()
    who = (ids if ids is not None else rows).select("series_id").distinct()
    spans = who.withColumn("_e", edge).where(F.col("_e.lo").isNotNull())
    spans = spans.select("series_id", F.lit(0).cast("long").alias("first"), F.floor((F.col("_e.hi") - F.col("_e.lo")) / n).alias("last"))
    cells = rows.withColumn("_e", edge).select("series_id", F.floor((F.col("s") - F.col("_e.lo")) / n).alias("pos"), "value")
    return SparseTrace(cells, materialise(spans, "series-ends"))


def _block(pos: str) -> Column:
    return F.floor(F.col(pos) / BLOCK)


def marked_runs(marks: DataFrame, spans: DataFrame) -> DataFrame:
    """``(series_id, start, stop, marked, last)``: stretches of marked positions and the stretches between them, over each series' span.

    ``marks``: distinct ``(series_id, pos)`` inside the spans.  A stretch's positions less their rank are one number, whatever its length.
    """
    numbered = ranked(marks.select(*KEY, "pos"), KEY, ["pos"], _block("pos"), "rn")
    islands = numbered.groupBy(*KEY, (F.col("pos") - F.col("rn")).alias("_g")).agg(F.min("pos").alias("start"), F.max("pos").alias("stop"))
    islands = materialise(islands.drop("_g"), "runs")
    sides = neighbours(islands, KEY, ["start"], _block("start"), {"before": (F.col("stop"), 1), "after": (F.col("start"), -1)}).join(spans, "series_id")
    no, yes = F.lit(False).alias("marked"), F.lit(True).alias("marked")
    lead = F.struct(F.coalesce(F.col("before") + 1, F.col("first")).alias("start"), (F.col("start") - 1).alias("stop"), no)
    own = F.struct("start", "stop", yes)
    tail = F.struct((F.col("stop") + 1).alias("start"), F.col("last").alias("stop"), no)
    each = F.array(lead, own, F.when(F.col("after").isNull(), tail))
    found = sides.select(*KEY, "last", F.explode(F.filter(each, lambda r: r.isNotNull() & (r["start"] <= r["stop"]))).alias("r"))
    blank = spans.join(islands, "series_id", "left_anti").select(*KEY, "last", F.struct(F.col("first").alias("start"), F.col("last").alias("stop"), no).alias("r"))
    return found.unionByName(blank).select(*KEY, "r.start", "r.stop", "r.marked", "last")


def runs(trace: SparseTrace, flag: Callable[[Column], Column], of_default: bool, names: tuple[str, str]) -> DataFrame:
    """``(series_id, kind, run_start, run_end, run_len, last)``: stretches in which ``flag`` of the value holds (the first name) or not (E5).

    ``of_default`` is the flag of the default; only listed cells that differ from it are sorted.
    """
    odd = trace.cells.where(flag(F.col("value")) != F.lit(of_default))
    found = marked_runs(odd, trace.spans)
    holds = F.col("marked") != F.lit(of_default)
    return found.select(
        *KEY, F.when(holds, names[0]).otherwise(names[1]).alias("kind"), F.col("start").alias("run_start"), F.col("stop").alias("run_end"),
        (F.col("stop") - F.col("start") + 1).alias("run_len"), "last",
    )


def null_runs(trace: SparseTrace) -> DataFrame:
    """Stretches without a value, and with one (E5)."""
    return runs(trace, lambda v: v.isNull(), trace.default is None, ("null", "seen"))


def zero_runs(trace: SparseTrace) -> DataFrame:
    """Stretches of zeros, and of anything else; a null is not zero (E5)."""
    return runs(trace, lambda v: F.coalesce(v == 0, F.lit(False)), trace.default == 0, ("zero", "other"))


def gap_histogram(trace: SparseTrace) -> DataFrame:
    """How many null gaps and zero gaps there are of each length (E6); no cell is written out."""
    both = null_runs(trace).where("kind = 'null'").unionByName(zero_runs(trace).where("kind = 'zero'"))
    return both.groupBy("kind", "run_len").agg(F.count(F.lit(1)).alias("n"))


def expanded(found: DataFrame, start: str, stop: str) -> DataFrame:
    """One row per position of each stretch, in two steps so that arrays stay short."""
    parts = found.withColumn("_from", F.explode(F.sequence(F.col(start), F.col(stop), F.lit(BLOCK).cast("long"))))
    upto = F.least(F.col("_from") + BLOCK - 1, F.col(stop))
    return parts.withColumn("pos", F.explode(F.sequence(F.col("_from"), upto))).drop("_from")


def gaps(trace: SparseTrace) -> DataFrame:
    """``(series_id, start, stop, _lp, _lv, _np, _nv, _first, _last)``: stretches without a value, and the values on both sides."""
    if trace.default is not None:
        raise ValueError("only traces without a default value have gaps")
    seen = trace.cells.where(F.col("value").isNotNull())
    pair = F.struct("pos", "value")
    sides = neighbours(seen, KEY, ["pos"], _block("pos"), {"before": (pair, 1), "after": (pair, -1)}).join(trace.spans, "series_id")
    gap = lambda a, b, lp, lv, np_, nv: F.struct(
        a.alias("start"), b.alias("stop"), lp.cast("long").alias("_lp"), lv.cast("double").alias("_lv"), np_.cast("long").alias("_np"), nv.cast("double").alias("_nv")
    )
    none = F.lit(None)
    lead = gap(
        F.coalesce(F.col("before.pos") + 1, F.col("first")), F.col("pos") - 1, F.col("before.pos"), F.col("before.value"), F.col("pos"), F.col("value")
    )
    tail = F.when(F.col("after").isNull(), gap(F.col("pos") + 1, F.col("last"), F.col("pos"), F.col("value"), none, none))
    each = F.filter(F.array(lead, tail), lambda g: g.isNotNull() & (g["start"] <= g["stop"]))
    ends = [F.col("first").alias("_first"), F.col("last").alias("_last")]
    found = sides.select(*KEY, *ends, F.explode(each).alias("g"))
    blank = trace.spans.join(seen, "series_id", "left_anti").select(*KEY, *ends, gap(F.col("first"), F.col("last"), none, none, none, none).alias("g"))
    return found.unionByName(blank).select(*KEY, "g.*", "_first", "_last")


def filled(trace: SparseTrace, rule: Column) -> DataFrame:
    """``(series_id, pos, value)`` of the whole grid, cells without a value by a rule over ``pos`` and the columns of ``gaps``."""
    seen = trace.cells.where(F.col("value").isNotNull()).select(*KEY, "pos", F.col("value").cast("double").alias("value"))
    return seen.unionByName(expanded(gaps(trace), "start", "stop").select(*KEY, "pos", rule.cast("double").alias("value")))


def laid_out(trace: SparseTrace, rule: Column, rest: dict[str, object] | None = None) -> DataFrame:
    """``(series_id, pos, value, *rest)`` of the whole grid, cells without a value by a rule over ``pos`` and ``_lp``, ``_lv``, ``_np``, ``_nv``, ``_first``, ``_last``.

    ``rest``: further columns of the listed cells, with what all other cells hold.  A listed cell writes out the cells between the one before it and itself, and a row
    behind each series' end those that are left: one scan of the listed cells, and no other cell is sorted or shuffled for it.  Cells without a series or a position are left out.
    """
    if trace.default is not None:
        raise ValueError("only traces without a default value have gaps")
    rest, end = rest or {}, F.col("last")
    listed = trace.cells.where(F.col("series_id").isNotNull() & F.col("pos").isNotNull())
    listed = listed.select(*KEY, "pos", F.col("value").cast("double").alias("value"), *rest, F.lit(True).alias("_own"))
    behind = trace.spans.where(end.isNotNull()).select(*KEY, (end + 1).alias("pos"), F.lit(False).alias("_own"), "first", "last")
    at = F.when(F.col("value").isNotNull(), F.col("pos"))
    found = scan(
        listed.unionByName(behind, allowMissingColumns=True),
        KEY,
        ["pos"],
        _block("pos"),
        prior={"_lp": at, "_lv": F.col("value"), "_before": F.col("pos")},
        following={"_np": at, "_nv": F.col("value")},
        whole={"_first": ("min", F.col("first")), "_last": ("min", F.col("last"))},
    )
    start = F.coalesce(F.col("_before") + 1, F.col("_first"), F.col("first"))
    stop = F.when(F.col("_own"), F.col("pos")).otherwise(F.col("pos") - 1)
    each = expanded(found.withColumns({"_start": start, "_stop": stop, "_at": F.col("pos")}).where("_start <= _stop"), "_start", "_stop")
    here = F.col("pos") == F.col("_at")
    value = F.when(here & F.col("value").isNotNull(), F.col("value")).otherwise(rule.cast("double"))
    return each.select(*KEY, "pos", value.alias("value"), *[F.when(here, F.col(c)).otherwise(F.lit(other)).alias(c) for c, other in rest.items()])


def linear_fill(trace: SparseTrace, rest: dict[str, object] | None = None) -> DataFrame:
    """Linear fill of every gap, edge gaps by the nearest value."""
    return laid_out(trace, line_held(), rest)


def linear_then_zero(trace: SparseTrace) -> DataFrame:
    """Forward linear fill, the last value held, and what is left becomes zero."""
    return laid_out(trace, line_then_zero())


def nearest_fill(trace: SparseTrace) -> DataFrame:
    """Each gap takes the nearer value; the earlier one on a tie."""
    return laid_out(trace, near_value())


def hold_leading(trace: SparseTrace) -> DataFrame:
    """The first value fills the start of the series; other gaps stay."""
    return laid_out(trace, F.when(F.col("_lp").isNull(), F.col("_nv")))


def constant_fill(trace: SparseTrace, limit: int, constant: float = -1.0) -> DataFrame:
    """Gaps up to ``limit`` long become a constant."""
    return laid_out(trace, F.when(gap_length() <= limit, F.lit(constant)))


def bounded_interpolation(trace: SparseTrace, limit: int, *, inclusive: bool = True) -> DataFrame:
    """Linear fill of gaps up to ``limit`` long, edge gaps by the nearest value; longer ones stay."""
    short = gap_length() <= limit if inclusive else gap_length() < limit
    return filled(trace, F.when(short, F.coalesce(line_between(), F.col("_lv"), F.col("_nv"))))


def zeros_to_null(trace: SparseTrace, z: int, *, mode: str = "chunked") -> DataFrame:
    """``(series_id, pos, value)`` of the whole grid with long zero runs blanked, by the modes of ``impute.zeros_to_null``."""
    if mode not in ("chunked", "run"):
        raise ValueError(f"unknown mode {mode}")
    zero = zero_runs(trace).where("kind = 'zero'")
    counted = F.col("run_len") - F.when(F.col("run_end") == F.col("last"), 1).otherwise(0)
    gone = F.floor(counted / z) * z if mode == "chunked" else F.when(F.col("run_len") >= z, F.col("run_len")).otherwise(0)
    left = F.when(F.col("pos") - F.col("run_start") >= gone, F.lit(0.0))
    zeros = expanded(zero, "run_start", "run_end").select(*KEY, "pos", left.alias("value"))
    others = trace.cells.where(~F.coalesce(F.col("value") == 0, F.lit(False))).select(*KEY, "pos", F.col("value").cast("double").alias("value"))
    if trace.default is None:
        unlisted = expanded(gaps(trace), "start", "stop").select(*KEY, "pos", F.lit(None).cast("double").alias("value"))
        return zeros.unionByName(others.where(F.col("value").isNotNull())).unionByName(unlisted)
    if trace.default == 0:
        return zeros.unionByName(others)
    raise ValueError("the default of a trace is nothing or zero")


def cells_of_runs(found: DataFrame) -> DataFrame:
    """One row per cell with its run: ``pos`` and ``run_pos``, counted from 1."""
    out = expanded(found, "run_start", "run_end")
    return out.withColumn("run_pos", F.col("pos") - F.col("run_start") + 1).drop("last")
