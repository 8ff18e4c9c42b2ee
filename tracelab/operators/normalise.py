"""Normalisation of samples: fit per position over the whole set, transform each array in place.

A fit gives one row with one array per parameter, as long as a sample.  The transform reads it
as a scalar subquery and works on the feature arrays, so the samples are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions import scalar
from tracelab.functions.quantile import array_median, let, medians
from tracelab.operators.joins import zip_features
from tracelab.operators.samples import sum_bins
from tracelab.session import materialise

Stats = dict[str, Callable[[Column], Column]]


def cells_of(df: DataFrame, *keep: str) -> DataFrame:
    """``(pos, x)`` rows of the feature arrays."""
    return df.select(*keep, F.posexplode("features").alias("pos", "x"))


def fit_positions(df: DataFrame, stats: Stats) -> DataFrame:
    """One row: ``params`` is an array of structs, one per position (K2)."""
    per = cells_of(df).groupBy("pos").agg(*[f(F.col("x")).alias(n) for n, f in stats.items()])
    return as_params(per, list(stats))


def fit_medians(df: DataFrame) -> DataFrame:
    """Exact median per position; null where every sample is null."""
    cells = cells_of(df)
    every = cells.select("pos").distinct()
    return as_params(every.join(medians(cells, ["pos"], "x"), "pos", "left"), ["median"])


def as_params(per: DataFrame, names: Sequence[str]) -> DataFrame:
    return per.groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("params"))


def settled(params: DataFrame, once: bool) -> DataFrame:
    """Fitted parameters, with ``once`` as a table of one row, so that a later fit does not plan and run this one again."""
    return materialise(params, "fit") if once else params


def transform_positions(df: DataFrame, params: DataFrame, fn: Callable[[Column, Column], Column], *, once: bool = False) -> DataFrame:
    """Apply ``fn(x, parameters of the position)`` to every cell (K2)."""
    params = settled(params, once)
    return (
        df.withColumn("_p", params.scalar())
        .withColumn("features", F.zip_with("features", "_p", lambda x, p: fn(x, p)))
        .drop("_p")
    )


def map_cells(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn("features", F.transform("features", lambda x: fn(x)))


def array_sum(arr: Column) -> Column:
    known = F.filter(arr, lambda x: x.isNotNull())
    return F.aggregate(known, F.lit(0.0), lambda a, x: a + x)


# -- quotient normalisation --------------------------------------------------


def quotient(df: DataFrame, *, residual: bool = False, peaks: bool = False, once: bool = False) -> DataFrame:
    """Divide each sample by the median of its ratios to the positions' medians.

    ``residual`` gives ``ln(anscombe(result)) - ln(anscombe(median))`` instead (N3).
    ``peaks`` takes the medians from the peak positions only (N2).
    """
    source = peak_filter(df) if peaks else df
    params = fit_medians(source).select(
        F.transform(
            "params", lambda p: F.when(p["median"] <= 0, F.lit(1.0)).otherwise(p["median"])
        ).alias("medians")
    )
    params = settled(params, once)
    ratio = F.zip_with("features", "_m", lambda x, m: F.when(x / m > 0, x / m))

    def scaled(factor: Column) -> Column:
        divisor = F.when(factor <= 0, F.lit(1.0)).otherwise(factor)
        return F.transform("features", lambda x: F.coalesce(x / divisor, F.lit(0.0)))

    out = df.withColumn("_m", params.scalar()).withColumn("features", let(array_median(ratio), scaled))
    if residual:
        diff = F.zip_with(
            "features", "_m", lambda x, m: F.log(scalar.anscombe(x)) - F.log(scalar.anscombe(m))
        )
        out = out.withColumn("features", diff)
    return out.drop("_m")


def peak_filter(df: DataFrame, span: int = 240, width: int | None = None) -> DataFrame:
    """Null every cell that is not beside a peak (N2); ``width`` defaults to the array's own."""
    w = F.lit(width) if width else F.size("features")
    peaks = F.ceil(w / span)
    stride = F.floor(w / peaks / 2)

    def keep(x: Column, i: Column) -> Column:
        single = (i >= stride - 1) & (i <= stride + 1)
        nearest = F.floor((i + 1) / stride)
        centre = nearest * stride
        several = (nearest % 2 == 1) & (i >= centre - 1) & (i < centre + 1)
        return F.when(F.when(peaks == 1, single).otherwise(several), x)

    return df.withColumn("features", F.transform("features", keep))


# -- per position ------------------------------------------------------------


def standard_scale(df: DataFrame, *, once: bool = False) -> DataFrame:
    """Zero mean and unit population deviation per position."""
    params = fit_positions(df, {"mean": F.avg, "std": F.stddev_pop})
    return transform_positions(df, params, lambda x, p: (x - p["mean"]) / F.when(p["std"] > 0, p["std"]).otherwise(F.lit(1.0)), once=once)


def centre_positions(df: DataFrame) -> DataFrame:
    """Subtract each position's mean."""
    return transform_positions(df, fit_positions(df, {"mean": F.avg}), lambda x, p: x - p["mean"])


def fit_min_max(df: DataFrame) -> DataFrame:
    return fit_positions(df, {"lo": F.min, "hi": F.max})


def min_max(df: DataFrame, params: DataFrame | None = None, eps: float = 0.0, *, once: bool = False) -> DataFrame:
    """Scale each position to 0–1 with its own or with stored limits."""

    def fn(x: Column, p: Column) -> Column:
        span = p["hi"] - p["lo"]
        width = span + F.lit(eps) if eps else F.when(span > 0, span).otherwise(F.lit(1.0))
        return (x - p["lo"]) / width

    return transform_positions(df, params if params is not None else fit_min_max(df), fn, once=once)


def inverse_min_max(df: DataFrame, params: DataFrame, eps: float = 0.0) -> DataFrame:
    """Back from 0–1 to the original range."""
    return transform_positions(df, params, lambda x, p: x * (p["hi"] - p["lo"] + F.lit(eps)) + p["lo"])


def round_categorical(imputed: DataFrame, original: DataFrame, below: int = 20) -> DataFrame:
    """Round positions that had fewer than ``below`` distinct values."""
    distinct = cells_of(original).filter(F.col("x").isNotNull()).distinct()
    per = distinct.groupBy("pos").agg(F.count(F.lit(1)).alias("kinds"))
    params = as_params(per, ["kinds"])
    return transform_positions(imputed, params, lambda x, p: F.when(p["kinds"] < below, F.bround(x)).otherwise(x))


# -- per sample and global ---------------------------------------------------


def l2(df: DataFrame) -> DataFrame:
    """Unit length per sample; a zero sample stays."""
    norm = F.sqrt(array_sum(F.transform("features", lambda x: x * x)))
    divisor = F.when(norm > 0, norm).otherwise(F.lit(1.0))
    return df.withColumn("features", let(divisor, lambda n: F.transform("features", lambda x: x / n)))


def centre(df: DataFrame, *, once: bool = False) -> DataFrame:
    """Subtract the mean over every cell of every sample."""
    mean = settled(cells_of(df).groupBy().agg(F.avg("x").alias("m")), once).scalar()
    return df.withColumn("_m", mean).withColumn("features", F.transform("features", lambda x: x - F.col("_m"))).drop("_m")


def centre_samples(df: DataFrame, *, by_deviation: bool = False) -> DataFrame:
    """Subtract each sample's mean, optionally divide by its deviation."""
    mean = array_sum(F.col("features")) / F.size("features")
    out = df.withColumn("features", let(mean, lambda m: F.transform("features", lambda x: x - m)))
    if by_deviation:
        std = F.sqrt(array_sum(F.transform("features", lambda x: x * x)) / F.size("features"))
        out = out.withColumn("features", let(std, lambda s: F.transform("features", lambda x: F.try_divide(x, s))))
    return out


# -- differences -------------------------------------------------------------


def day_difference(df: DataFrame, day: int, *, append: bool = False) -> DataFrame:
    """``x[t] - x[t - day]`` in place of, or after, the features."""
    n = F.size("features")
    later = F.slice("features", day + 1, F.greatest(n - day, F.lit(0)))
    diff = F.zip_with(later, F.slice("features", 1, F.greatest(n - day, F.lit(0))), lambda a, b: a - b)
    return df.withColumn("features", F.concat("features", diff) if append else diff)


def last_day_difference(df: DataFrame, day: int, *, append: bool = False) -> DataFrame:
    """Every earlier day minus the last day."""
    n = F.size("features")
    head = F.slice("features", 1, n - day)
    last = F.slice("features", n - day + 1, F.lit(day))
    diff = let(last, lambda tail: F.transform(head, lambda x, i: x - F.get(tail, i % day)))
    return df.withColumn("features", F.concat("features", diff) if append else diff)


# -- steps -------------------------------------------------------------------


def steps_table(day: int) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Step name → transformation; fitted steps run their fit once, as they are applied."""
    return {
        "ANSCOMBE": lambda d: map_cells(d, scalar.anscombe),
        "SQRT": lambda d: map_cells(d, F.sqrt),
        "LOG": lambda d: map_cells(d, scalar.masked_log),
        "EXP": lambda d: map_cells(d, F.exp),
        "L2": l2,
        "QN": lambda d: quotient(d, once=True),
        "MINMAX": lambda d: min_max(d, once=True),
        "STANDARDSCALER": lambda d: standard_scale(d, once=True),
        "CENTER": lambda d: centre(d, once=True),
        "DIFF": lambda d: day_difference(d, day),
        "DIFFAPPEND": lambda d: day_difference(d, day, append=True),
        "DIFFLASTD": lambda d: last_day_difference(d, day),
        "DIFFLASTDAPPEND": lambda d: last_day_difference(d, day, append=True),
        "RESAMPLE": lambda d: d.withColumn("features", sum_bins(day)),
    }


def apply_steps(
    df: DataFrame, steps: Sequence[str], *, day: int = 1440, exogenous: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Apply named steps in order (N11); an unknown name raises before any work.

    A fitted step reads the input through the steps before it, whose parameters are tables by then: its plan grows by one small scan per
    earlier fit.

    ``APPEND`` starts a second branch from the input, whose features follow the first's (G5).
    ``TEMPERATURE``, ``HUMIDITY``, … replace the features by the exogenous arrays of that name,
    with the suffix ``APPEND`` they follow the features (N12).
    """
    table, exo = steps_table(day), exogenous or {}
    known = set(table) | {"APPEND"} | set(exo) | {f"{e}APPEND" for e in exo}
    unknown = [s for s in steps if s not in known]
    if unknown:
        raise ValueError(f"unknown steps {unknown}; known are {sorted(known)}")
    if "APPEND" in steps:
        cut = list(steps).index("APPEND")
        first = apply_steps(df, steps[:cut], day=day, exogenous=exo)
        second = apply_steps(df, steps[cut + 1 :], day=day, exogenous=exo)
        return zip_features(first, second)
    for s in steps:
        if s in table:
            df = table[s](df)
        elif s in exo:
            df = df.drop("features").join(exo[s].select("sample_id", "features"), "sample_id")
        else:
            df = zip_features(df, exo[s.removesuffix("APPEND")])
    return df
