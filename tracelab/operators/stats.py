"""Counts, distributions, rankings and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.quantile import let, medians, middle_value, quantiles, value_bucket, with_medians
from tracelab.functions.scan import ranked
from tracelab.functions.hashing import SPAN, draw, draw_bucket
from tracelab.operators.normalise import array_sum, cells_of, transform_positions
from tracelab.operators.splits import hash_rank


# -- class counts ------------------------------------------------------------


def class_counts(df: DataFrame, label: str = "label", valid: str = "valid") -> DataFrame:
    """Valid, not valid and all samples per label, with a total row."""
    return (
        df.rollup(label)
        .agg(
            F.grouping(label).alias("_g"),
            F.count_if(F.col(valid)).alias("valid"),
            F.count_if(~F.col(valid)).alias("not_valid"),
            F.count(F.lit(1)).alias("total"),
        )
        .withColumn(label, F.when(F.col("_g") == 1, "total").otherwise(F.col(label)))
        .drop("_g")
    )


def label_pivot(df: DataFrame, labels: Sequence[str], key: str = "series_id", label: str = "label") -> DataFrame:
    """Samples per individual with one column per label of a stated domain."""
    return df.groupBy(key).pivot(label, list(labels)).agg(F.count(F.lit(1))).fillna(0)


def transition_matrix(df: DataFrame, prev: str, curr: str, scale: int = 5) -> DataFrame:
    """Counts of every score pair of the scale, zeros included."""
    known = df.filter(F.col(prev).isNotNull() & F.col(curr).isNotNull())
    counts = known.groupBy(prev, curr).agg(F.count(F.lit(1)).alias("_n"))
    pair = F.col("id")
    grid = df.sparkSession.range(scale * scale).select(
        (F.floor(pair / scale) + 1).cast("int").alias(prev), (pair % scale + 1).cast("int").alias(curr)
    )
    return grid.join(counts, [prev, curr], "left").select(prev, curr, F.coalesce("_n", F.lit(0)).alias("n"))


def validity_per_individual(df: DataFrame, valid: str = "valid", key: str = "series_id") -> DataFrame:
    """Valid and invalid samples per individual, largest first."""
    return (
        df.groupBy(key)
        .agg(F.count_if(F.col(valid)).alias("valid"), F.count_if(~F.col(valid)).alias("invalid"), F.count(F.lit(1)).alias("total"))
        .orderBy(F.col("total").desc(), key)
    )


def value_counts_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """``{value: count}`` per individual for a short-domain column."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))


def listed(df: DataFrame, key: str, item: str, piece: int = 10_000) -> DataFrame:
    """Items per key as ordered lists of at most ``piece`` items."""
    numbered = hash_rank(df, [key], draw("list", item), item, "_n")
    out = numbered.groupBy(key, F.floor((F.col("_n") - 1) / piece).alias("part"))
    return out.agg(F.sort_array(F.collect_list(item)).alias("items"))


def dataset_span(df: DataFrame, *, key: str, date: str, order: str) -> DataFrame:
    """Individuals, rows, first and last date, and the dates of the first, middle and last row by a number ``order`` that no two rows share.

    The middle row is found by its rank; no row is numbered.
    """
    agg = df.groupBy().agg(
        F.count_distinct(key).alias("individuals"),
        F.count(F.lit(1)).alias("n"),
        F.min(date).alias("min_date"),
        F.max(date).alias("max_date"),
        F.min_by(date, order).alias("first_date"),
        F.max_by(date, order).alias("last_date"),
    )
    at = middle_value(df, [], order).select("middle").scalar()
    middle = df.withColumn("_at", at).where(F.col(order).cast("double") == F.col("_at")).groupBy().agg(F.min(date).alias("d"))
    return agg.withColumn("middle_date", middle.scalar())


# -- distributions -----------------------------------------------------------


def entropy(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Shannon entropy of the value counts (D11), in nats."""
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    # -sum(c/n ln(c/n)) = ln n - sum(c ln c)/n
    return counts.groupBy(*keys).agg(
        (F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("entropy")
    )


def weight_entropy(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Entropy with each value's share of the sum as its probability."""
    v = F.when(F.col(value) > 0, F.col(value))
    return df.groupBy(*keys).agg((F.log(F.sum(v)) - F.sum(v * F.log(v)) / F.sum(v)).alias("entropy"))


def histogram_entropy(df: DataFrame, keys: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Entropy of an equal-width histogram between each key's minimum and maximum."""
    keys = list(keys)
    edges = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    at = F.when(span > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / span * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    binned = df.filter(F.col(value).isNotNull()).join(edges, keys).withColumn("_bin", at)
    return entropy(binned, keys, "_bin")


def rounded_histogram(df: DataFrame, keys: Sequence[str], value: str, base: float) -> DataFrame:
    """Counts of values rounded to a base."""
    at = (F.bround(F.col(value) / F.lit(float(base))) * F.lit(float(base))).alias("bin")
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, at).agg(F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, keys: Sequence[str], value: str, bins: int = 50) -> DataFrame:
    """Equal-width density of values on [0, 1]."""
    v = F.col(value)
    inside = df.filter(v.between(0, 1))
    at = F.least(F.floor(v * bins), F.lit(bins - 1)).alias("bin")
    counts = inside.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("n"))
    total = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    joined = counts.join(total, list(keys)) if keys else counts.withColumn("_t", total.select("_t").scalar())
    return joined.withColumn("density", F.col("n") * bins / F.col("_t")).drop("_t")


# -- curves ------------------------------------------------------------------


def class_curves(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and median per class and position."""
    cells = cells_of(df, *by)
    keys = [*by, "pos"]
    return with_medians(cells.groupBy(*keys).agg(F.avg("x").alias("mean")), cells, keys, {"median": "x"})


def percent_zero(df: DataFrame, features: str = "features") -> DataFrame:
    """Percent of zero cells per sample."""
    zeros = F.size(F.filter(features, lambda x: x == 0))
    return df.withColumn("percent_zero", zeros * 100.0 / F.size(features))


def percent_zero_by_class(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg("percent_zero").alias("mean_percent"),
        F.max("percent_zero").alias("max_percent"),
    )


def light_stats(cells: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median and population deviation of a weight per group."""
    agg = cells.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    return with_medians(agg, cells, keys, {"median": value})


def sun_envelope(days: DataFrame, share: float = 0.5) -> DataFrame:
    """Extremes of sunrise and sunset and the central share of day and night.

    ``days``: ``(sunrise, sunset)`` in seconds of the day; hours are stepped from the start.
    """
    agg = days.groupBy().agg(
        F.min("sunrise").alias("sunrise_min"),
        F.max("sunrise").alias("sunrise_max"),
        F.min("sunset").alias("sunset_min"),
        F.max("sunset").alias("sunset_max"),
    )
    for name, start, stop in (
        ("day", F.col("sunrise_max"), F.col("sunset_min")),
        ("night", F.col("sunset_max"), F.col("sunrise_min") + 86400),
    ):
        hours = F.floor((stop - start) / 3600) + 1
        mid, side = F.floor(hours / 2), F.floor(hours / 2 * share)
        agg = agg.withColumns(
            {
                f"mid_{name}": (start + mid * 3600) % 86400,
                f"{name}_from": (start + (mid - side) * 3600) % 86400,
                f"{name}_to": (start + (mid + side) * 3600) % 86400,
            }
        )
    return agg


# -- rankings ----------------------------------------------------------------


def top_rows(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows (F2)."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows per group (F2, E17); Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def activity_ranking(df: DataFrame) -> DataFrame:
    """Series by their number of positive values."""
    return df.groupBy("series_id").agg(F.count_if(F.col("value") > 0).alias("active")).orderBy(F.col("active").desc(), "series_id")


def rows_per_individual(df: DataFrame, key: str = "series_id") -> DataFrame:
    """Individuals by their number of rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), key)


def signal_summary(df: DataFrame) -> DataFrame:
    """Points, extremes, first and last time and span per series."""
    return df.groupBy("series_id").agg(
        F.count("value").alias("points"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min_by("value", "ts").alias("first_value"),
        F.max_by("value", "ts").alias("last_value"),
        (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("span_s"),
    )


def keep_large_groups(df: DataFrame, keys: Sequence[str], at_least: int) -> DataFrame:
    """Rows of configurations with at least ``at_least`` rows."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least)
    return df.join(big.select(*keys), list(keys), "left_semi")


def sample_rows(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Exactly ``n`` rows chosen by draw (F6), ranked in slices of the draw, so that ``n`` may be large."""
    drawn = df.withColumns({"_d": draw(seed, *key), "_all": F.lit(0)})
    return ranked(drawn, ["_all"], ["_d", *key], draw_bucket(F.col("_d")), "_rank").filter(F.col("_rank") <= n).drop("_d", "_all", "_rank")


def sample_share(df: DataFrame, share: float, seed: int, key: Sequence[str]) -> DataFrame:
    """Every row kept with the same chance, by draw."""
    return df.filter(draw(seed, *key) < F.lit(int(share * SPAN)))


# -- weights on positions ----------------------------------------------------


def _kth_largest(k: Column, features: str) -> Column:
    """The ``k``-th largest ``(value, position)`` of an array."""
    tagged = F.transform(features, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.get(F.sort_array(tagged, asc=False), k - 1)


def keep_top_share(df: DataFrame, divisor: int, features: str = "features") -> DataFrame:
    """Keep the largest ``n / divisor`` cells of each array, zero the rest."""
    cut = _kth_largest(F.floor(F.size(features) / divisor).cast("int"), features)

    def kept(c: Column) -> Column:
        return F.transform(
            features, lambda x, i: F.when(F.struct(x.alias("x"), i.alias("i")) >= c, x).otherwise(F.lit(0.0))
        )

    return df.withColumn(features, let(cut, kept))


def blank_largest(df: DataFrame, n: int, features: str = "features") -> DataFrame:
    """Null the ``n`` largest cells of each array, the last position first on ties."""
    cut = _kth_largest(F.least(F.lit(n), F.size(features)), features)

    def kept(c: Column) -> Column:
        return F.transform(features, lambda x, i: F.when(F.struct(x.alias("x"), i.alias("i")) < c, x))

    return df.withColumn(features, let(cut, kept))


def scaled_weights(params: DataFrame, name: str = "w") -> DataFrame:
    """Weights per position scaled to 0–1."""
    with_edges = params.select("params", F.transform("params", lambda p: p[name]).alias("_w")).select(
        "params", F.array_min("_w").alias("_lo"), F.array_max("_w").alias("_hi")
    )
    return with_edges.select(
        F.transform(
            "params",
            lambda p: F.struct(p["pos"].alias("pos"), F.try_divide(p[name] - F.col("_lo"), F.col("_hi") - F.col("_lo")).alias(name)),
        ).alias("params")
    )


def weight_features(df: DataFrame, params: DataFrame, name: str = "w") -> DataFrame:
    """Multiply each sample by position weights."""
    return transform_positions(df, params, lambda x, p: x * p[name])


def distance_to_plane(df: DataFrame, params: DataFrame, bias: float, name: str = "w") -> DataFrame:
    """``|w·x + b| / ‖w‖`` per sample from given position weights."""
    out = df.withColumn("_p", params.scalar())
    dot = array_sum(F.zip_with("features", "_p", lambda x, p: x * p[name]))
    norm = F.sqrt(array_sum(F.transform("_p", lambda p: p[name] * p[name])))
    return out.withColumn("dist", F.try_divide(F.abs(dot + F.lit(bias)), norm)).drop("_p")


def distance_buckets(df: DataFrame, label: str, size: int) -> DataFrame:
    """Consecutive buckets of ``size`` samples per class by distance: mean curve and range."""
    numbered = ranked(df, [label], ["dist", "sample_id"], value_bucket(F.col("dist")), "_rn")
    cells = numbered.withColumn("bucket", F.ceil(F.col("_rn") / size)).select(
        label, "bucket", "dist", F.posexplode("features").alias("pos", "x")
    )
    return cells.groupBy(label, "bucket", "pos").agg(
        F.avg("x").alias("mean"), F.min("dist").alias("low"), F.max("dist").alias("high")
    )


# -- configurations ----------------------------------------------------------


def percentile_interval(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """2.5, 50 and 97.5 percentiles, nulls skipped."""
    return quantiles(df, keys, value, {"low": 0.025, "median": 0.5, "high": 0.975})


def best_configuration(df: DataFrame, farm: str, config: str, score: str, *, highest: bool = True) -> DataFrame:
    """One configuration per farm by its median score (M18); ``highest=False`` keeps the lowest."""
    med = medians(df, [farm, config], score, "median")
    first = F.col("median").desc() if highest else F.col("median")
    return top_per_group(med, [farm], [first, F.col(config)], 1)


def delta_to_best(df: DataFrame, config: str, fold: str, score: str) -> DataFrame:
    """Score minus the best configuration's score on the same fold.

    ``df`` holds one score per configuration and fold; the best has the highest median.
    """
    med = medians(df, [config], score, "median")
    best = top_rows(med, 1, [F.col("median").desc(), F.col(config)]).select(config)
    of_best = df.join(best, config, "left_semi").select(fold, F.col(score).alias("_best"))
    return df.join(of_best, fold).withColumn("delta", F.col(score) - F.col("_best")).drop("_best")


def report(df: DataFrame, config: str, fold: str, means: Sequence[str], total: str) -> DataFrame:
    """One row per configuration: means, per-fold list of the first metric, total of a column.

    The list has one entry per fold, so it is as long as the cross-validation.
    """
    per_fold = df.groupBy(config, fold).agg(F.avg(means[0]).alias("_m"))
    lists = per_fold.groupBy(config).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(fold, "_m"))), lambda s: s["_m"]).alias(f"{means[0]}_list")
    )
    agg = df.groupBy(config).agg(*[F.avg(m).alias(f"{m}_mean") for m in means], F.sum(total).alias(f"{total}_total"))
    return agg.join(lists, config)


def daily_weather(hours: DataFrame, columns: Sequence[str], hour: str = "hour") -> DataFrame:
    """Mean of each reading per day, and how many hours it has."""
    return hours.groupBy(F.to_date(hour).alias("day")).agg(F.count(F.lit(1)).alias("hours"), *[F.avg(c).alias(c) for c in columns])


def metric_pivot(df: DataFrame, rows: Sequence[str], column: str, domain: Sequence[object], metric: str) -> DataFrame:
    """Mean of a metric with a column for each value of a stated domain, and ``…_other`` for all else, nulls too."""
    known = list(domain)
    at = F.when(F.col(column).isin(*known), F.col(column).cast("string")).otherwise(F.lit("other"))
    names = [*map(str, known), "other"]
    wide = df.withColumn("_at", at).groupBy(*rows).pivot("_at", names).agg(F.avg(metric))
    return wide.select(*rows, *[F.col(f"`{n}`").alias(f"{column}_{n}") for n in names])


def grid_search_summary(df: DataFrame, c: str, gamma: str, score: str, keep_c: object) -> DataFrame:
    """Scores floored at 0.5, median per (C, gamma), only gammas that occur with ``keep_c``."""
    floored = df.withColumn("_s", F.greatest(F.col(score), F.lit(0.5)))
    wanted = df.filter(F.col(c) == keep_c).select(gamma)
    return medians(floored, [c, gamma], "_s", "median").join(wanted, gamma, "left_semi")


def find_ids(lines: DataFrame, ids: DataFrame, *, text: str, file: str, key: str) -> DataFrame:
    """How many lines of each file mention each id as a whole number.

    Numbers are cut out of the text, counted per file and joined on equality; a line counts once
    per id.
    """
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)))
    found = lines.select(file, F.explode(numbers).alias("_t")).select(file, F.col("_t").try_cast("long").alias(key))
    counted = found.groupBy(key, file).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(ids.select(key).distinct(), key)
