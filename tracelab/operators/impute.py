"""Gap detection, gap filling, masking and imputation error on gridded series.

Input is a grid: one row per ``(series_id, pos)`` with consecutive ``pos`` from 0 and a
nullable ``value``.  Blocks of positions bound every window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.hashing import SPAN, draw
from tracelab.functions.quantile import quantiles
from tracelab.functions.scan import neighbours, runs, scan, with_halo
from tracelab.session import materialise

BLOCK = 1440
KEY = ["series_id"]


def block_of(pos: str = "pos") -> Column:
    return F.floor(F.col(pos) / BLOCK)


def null_runs(df: DataFrame) -> DataFrame:
    """Run start, end and length of null / non-null stretches (E5)."""
    empty = F.col("value").isNull()
    return runs(df, KEY, "pos", empty, BLOCK).withColumn("kind", F.when(empty, "null").otherwise("seen"))


def zero_runs(df: DataFrame) -> DataFrame:
    """The same for zero / non-zero stretches; a null is not zero."""
    zero = F.coalesce(F.col("value") == 0, F.lit(False))
    return runs(df, KEY, "pos", zero, BLOCK).withColumn("kind", F.when(zero, "zero").otherwise("other"))


def gap_histogram(df: DataFrame) -> DataFrame:
    """How many null gaps and zero gaps there are of each duration."""
    parts = []
    for marked, kind in ((null_runs(df), "null"), (zero_runs(df), "zero")):
        first = marked.filter((F.col("kind") == kind) & (F.col("pos") == F.col("run_start")))
        parts.append(first.groupBy("kind", "run_len").agg(F.count(F.lit(1)).alias("n")))
    return parts[0].unionByName(parts[1])


def _around(df: DataFrame) -> DataFrame:
    """Attach position and value of the nearest observation on both sides, and the series' ends."""
    at = F.when(F.col("value").isNotNull(), F.col("pos"))
    return scan(
        df,
        KEY,
        ["pos"],
        block_of(),
        last={"_lp": at, "_lv": F.col("value")},
        following={"_np": at, "_nv": F.col("value")},
        whole={"_first": ("min", F.col("pos")), "_last": ("max", F.col("pos"))},
    )


def line_between() -> Column:
    """Height at ``pos`` of the line between the values on both sides."""
    lp, lv, np_, nv = F.col("_lp"), F.col("_lv"), F.col("_np"), F.col("_nv")
    return lv + (nv - lv) * (F.col("pos") - lp) / (np_ - lp)


def line_held() -> Column:
    """That line, and before the first or after the last value the nearest one."""
    return F.coalesce(line_between(), F.col("_lv"), F.col("_nv"))


def line_then_zero() -> Column:
    """That line, after the last value that one, and zero before the first."""
    return F.coalesce(line_between(), F.col("_lv"), F.lit(0.0))


def near_value() -> Column:
    """The nearer of the values on both sides; the earlier one on a tie."""
    left_near = (F.col("pos") - F.col("_lp")) <= (F.col("_np") - F.col("pos"))
    return F.when(left_near, F.col("_lv")).otherwise(F.coalesce(F.col("_nv"), F.col("_lv")))


def gap_length() -> Column:
    """Cells between the values on both sides, or the series' ends."""
    start = F.coalesce(F.col("_lp"), F.col("_first") - 1)
    stop = F.coalesce(F.col("_np"), F.col("_last") + 1)
    return stop - start - 1


def _result(df: DataFrame, value: Column, like: DataFrame) -> DataFrame:
    filled = F.when(F.col("value").isNull(), value).otherwise(F.col("value"))
    return df.withColumn("value", filled).select(*like.columns)


def bounded_interpolation(df: DataFrame, limit: int, *, inclusive: bool = True) -> DataFrame:
    """Linear fill of null runs up to ``limit`` long; edge runs repeat the nearest value."""
    short = gap_length() <= limit if inclusive else gap_length() < limit
    return _result(_around(df), F.when(short, line_held()), df)


def constant_fill(df: DataFrame, limit: int, constant: float = -1.0) -> DataFrame:
    """Null runs up to ``limit`` long become a constant."""
    return _result(_around(df), F.when(gap_length() <= limit, F.lit(constant)), df)


def linear_fill(df: DataFrame) -> DataFrame:
    """Linear fill of every gap, in both directions."""
    return _result(_around(df), line_held(), df)


def nearest_fill(df: DataFrame) -> DataFrame:
    """Each gap takes the nearer observed value; the earlier one on a tie."""
    return _result(_around(df), near_value(), df)


def hold_leading(df: DataFrame) -> DataFrame:
    """The first observed value fills the start of the series; other gaps stay."""
    return _result(_around(df), F.when(F.col("_lp").isNull(), F.col("_nv")), df)


def linear_then_zero(df: DataFrame) -> DataFrame:
    """Forward linear fill, the last value held, and what is left becomes zero."""
    return _result(_around(df), line_then_zero(), df)


def zeros_to_null(df: DataFrame, z: int, *, mode: str = "chunked") -> DataFrame:
    """Blank long zero runs.

    ``chunked``: blank whole chunks of ``z`` and keep the rest of the run; in a run that ends
    the series the last record does not count.  ``run``: blank all of a run of at least ``z``.
    """
    zero = F.coalesce(F.col("value") == 0, F.lit(False))
    marked = runs(df, KEY, "pos", zero, BLOCK, end="_last").withColumn("kind", F.when(zero, "zero").otherwise("other"))
    if mode == "run":
        blank = F.col("run_len") >= z
        return marked.withColumn("value", F.when(~((F.col("kind") == "zero") & blank), F.col("value"))).select(
            *df.columns
        )
    if mode != "chunked":
        raise ValueError(f"unknown mode {mode}")
    counted = F.col("run_len") - F.when(F.col("run_end") == F.col("_last"), 1).otherwise(0)
    blank = F.col("pos") - F.col("run_start") < F.floor(counted / z) * z
    return (
        marked.withColumn("value", F.when(~((F.col("kind") == "zero") & blank), F.col("value")))
        .select(*df.columns)
    )


def elapsed_since_seen(df: DataFrame) -> DataFrame:
    """Steps since the last observation: 1 at a seen cell and at the start, then counting up."""
    seen = F.when(F.col("value").isNotNull() | (F.col("pos") == 0), F.col("pos"))
    out = scan(df, KEY, ["pos"], block_of(), last={"_seen": seen})
    return out.withColumn("elapsed", F.col("pos") - F.col("_seen") + 1).drop("_seen")


def moving_average(df: DataFrame, width: int, *, centred: bool = False) -> DataFrame:
    """Mean over ``width`` consecutive cells, complete frames only; nulls void the frame."""
    frame = Window.partitionBy(*KEY, "block").orderBy("pos").rowsBetween(-(width - 1), 0)
    cut = with_halo(df, "pos", BLOCK, width - 1)
    full = F.count("value").over(frame) == width
    out = cut.withColumn("mean", F.when(full, F.avg("value").over(frame))).filter("home")
    shift = (width - 1) // 2 if centred else 0
    return out.filter(F.col("mean").isNotNull()).select(*KEY, (F.col("pos") - shift).alias("pos"), "mean")


def derivative(df: DataFrame, dx: float) -> DataFrame:
    """``(y - previous y) / dx`` along the grid."""
    out = neighbours(df, KEY, ["pos"], block_of(), {"_y": (F.col("value"), 1)})
    return out.withColumn("slope", (F.col("value") - F.col("_y")) / F.lit(dx)).drop("_y")


def missing_mask(df: DataFrame, rate: float, seed: int) -> DataFrame:
    """Mark a seeded share of the observed non-zero cells."""
    eligible = F.coalesce(F.col("value") != 0, F.lit(False))
    picked = draw(seed, "series_id", "pos") < F.lit(int(rate * SPAN))
    return df.withColumn("masked", (eligible & picked).cast("int"))


def blank_masked(df: DataFrame) -> DataFrame:
    """Null the marked cells, keeping the truth beside them."""
    return df.withColumns({"truth": F.col("value"), "value": F.when(F.col("masked") == 0, F.col("value"))})


def imputation_error(df: DataFrame, keys: Sequence[str], *, truth: str = "truth", value: str = "value") -> DataFrame:
    """MAE, MSE and RMSE on the marked cells."""
    err = F.col(truth) - F.col(value)
    held_out = df.filter(F.col("masked") == 1)
    return held_out.groupBy(*keys).agg(
        F.count(err).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("mse"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
    )


def weighted_sample_error(df: DataFrame, keys: Sequence[str], *, truth: str = "truth", value: str = "value", weight: str = "weight") -> DataFrame:
    """``(keys, weight, rmse)``: weighted RMSE of each sample, nulls counting as zero (T15); null where no cell has a weight."""
    err = F.coalesce(truth, F.lit(0.0)) - F.coalesce(value, F.lit(0.0))
    out = df.groupBy(*keys).agg(F.sum(weight).alias("weight"), F.sum(F.col(weight) * err * err).alias("_e"))
    return out.withColumn("rmse", F.sqrt(F.col("_e") / F.nullif("weight", F.lit(0.0)))).drop("_e")


def error_by_ceiling(df: DataFrame, ceilings: Sequence[float]) -> DataFrame:
    """RMSE on the marked cells whose truth is at least each ceiling share of the maximum."""
    held = df.filter(F.col("masked") == 1)
    held = held.withColumn("_top", held.groupBy().agg(F.max("truth").alias("m")).scalar())
    levels = F.array(*[F.lit(float(c)) for c in ceilings])
    hit = F.explode(F.filter(levels, lambda c: F.col("truth") >= c * F.col("_top"))).alias("ceiling")
    err = F.col("truth") - F.col("value")
    return held.select(hit, err.alias("e")).groupBy("ceiling").agg(
        F.count("e").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse")
    )


def bootstrap_error(df: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Percentiles of the RMSE over resamples of whole series with replacement.

    Cells are reduced to one error sum per series first; every series then has one array of how often
    each replicate draws it, and the weighted sums are added up as arrays.
    """
    from tracelab.operators.evaluate import weight_arrays, weighted_totals
    from tracelab.operators.splits import resample_weights

    err = F.col("truth") - F.col("value")
    per = df.filter(F.col("masked") == 1).groupBy("series_id").agg(F.sum(err * err).alias("sse"), F.count(err).alias("n"))
    per = materialise(per, "series-errors")
    weights = weight_arrays(resample_weights(per, "series_id", replicates, seed), "series_id", replicates)
    rmse = weighted_totals(per.join(weights, "series_id"), ["sse", "n"], replicates).select(F.sqrt(F.try_divide("sse", "n")).alias("rmse"))
    return quantiles(materialise(rmse, "replicate-errors"), [], "rmse", {"low": 0.025, "median": 0.5, "high": 0.975})


def sample_day_flags(df: DataFrame, day_cells: int) -> DataFrame:
    """Per sample: days whose every cell is flagged as imputed, and days without a null.

    ``df``: ``(sample_id, pos, value, imputed)``.
    """
    day = df.groupBy("sample_id", F.floor(F.col("pos") / day_cells).alias("day")).agg(
        F.min("imputed").alias("all_imputed"),
        F.min(F.col("value").isNotNull().cast("int")).alias("complete"),
        F.count(F.lit(1)).alias("cells"),
    )
    whole = F.col("cells") == day_cells
    return day.groupBy("sample_id").agg(
        F.count_if((F.col("all_imputed") == 1) & whole).alias("imputed_days"),
        F.count_if((F.col("complete") == 1) & whole).alias("complete_days"),
    )
