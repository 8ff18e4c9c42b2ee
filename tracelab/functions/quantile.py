"""Exact quantiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one task.  Here a sketch
brackets each wanted rank, and only the values inside the brackets are shuffled and sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.session import materialise

ACCURACY = 1000  # of the sketch: a bracket holds some four thousandths of a group
SLICES = 1024  # of a bracket, sorted by themselves
FEW = 4096  # values of a group that are sorted as one array

# buckets per factor e of magnitude, and the magnitude below which buckets get wider
PER_E = 4096
FINE = 1e-3


def value_bucket(value: Column) -> Column:
    """Monotone bucket number of a value: even steps on a signed log scale.

    It depends on the value alone, so no pass for the limits is needed; a group has at most some
    80,000 buckets between 0.001 and a million, however many rows it holds.
    """
    steps = F.signum(value) * F.floor(F.log1p(F.abs(value) / F.lit(FINE)) * F.lit(float(PER_E)))
    # never null, so that a join on it adds no filter and both sides can share one shuffle
    return F.coalesce(steps.cast("long"), F.lit(0).cast("long"))


def _bracketed(slim: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """``(keys, n, _q)``: a group's number of values, and for each probability a lower and an upper value from a mergeable sketch.

    The sketch is off by less than ``1 / ACCURACY`` of the ranks, and twice that is left on both sides.  Written out, so that its size is known
    before the values meet it: Spark then sends it to the values, unless groups are so many that it is large itself.
    """
    around = [min(1.0, max(0.0, p + side)) for p in probs for side in (-2 / ACCURACY, 2 / ACCURACY)]
    sketch = F.approx_percentile("_v", F.array(*[F.lit(a) for a in around]), F.lit(ACCURACY))
    found = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketch.alias("_q"))
    return materialise(found.where("n > 0"), "brackets")


def middle_value(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """``(keys, n, middle)``: the value with ``n // 2`` values before it; whole numbers up to 2**53 are exact."""
    return quantiles(df, keys, value, {"middle": 0.5}, rank=lambda n: F.floor(n / 2))


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str | Column, probs: dict[str, float], *, rank: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row per key with exact, linearly interpolated quantiles ``{name: p}`` and ``n``.

    Nulls and NaNs are skipped; groups without a value are absent.  The values are written out once.  Groups of up to ``FEW`` values are sorted as they are.  For
    the others a sketch brackets each wanted rank; one pass then counts what lies below the bracket
    and keeps the values inside, and only these are sorted, in slices of the bracket.  The next value on either side is kept with the
    counts, for a rank that falls between two values at the edge.  ``rank`` may name another rank, at most one off those of the probabilities.
    """
    keys, names = list(keys), list(probs)
    at = [float(probs[n]) for n in names]
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    slim = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if not keys:
        return _by_brackets(slim, keys, names, at, rank)
    slim = materialise(slim, "values")
    large = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW)
    large = materialise(large.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]), "large-groups")
    if large.isEmpty():
        return _by_arrays(slim, keys, names, at, rank)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    small = _by_arrays(slim.join(large, on, "left_anti"), keys, names, at, rank)
    return small.unionByName(_by_brackets(slim.join(large, on, "left_semi"), keys, names, at, rank))


def _by_arrays(slim: DataFrame, keys: list[str], names: list[str], at: list[float], rank: Callable[[Column], Column] | None) -> DataFrame:
    """Quantiles of groups that are few values each."""
    held = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("_v")).alias("_all"))

    def between(p: float) -> Column:
        r = rank(F.col("n")) if rank is not None else (F.col("n") - 1) * F.lit(p)
        lo, hi = F.get("_all", F.floor(r).cast("int")), F.get("_all", F.ceil(r).cast("int"))
        return lo + (hi - lo) * (r - F.floor(r))

    return held.select(*keys, "n", *[between(p).alias(name) for p, name in zip(at, names, strict=True)])


def _by_brackets(slim: DataFrame, keys: list[str], names: list[str], at: list[float], rank: Callable[[Column], Column] | None) -> DataFrame:
    """Quantiles of groups of any size."""
    brackets = _bracketed(slim, keys, at)
    if keys:
        other = brackets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", "_q")
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        met = slim.join(other, on).drop(*[f"_k{i}" for i in range(len(keys))])
    else:
        met = slim.withColumn("_b", brackets.select(F.struct("n", "_q").alias("b")).scalar()).select("_v", "_b.n", "_b._q")

    def placed(i: int) -> Column:
        lo, hi = F.get("_q", F.lit(2 * i)), F.get("_q", F.lit(2 * i + 1))
        inside = F.col("_v").between(lo, hi)
        share = F.try_divide(F.col("_v") - lo, hi - lo)
        part = F.least(F.lit(SLICES - 1), F.coalesce(F.floor(share * SLICES), F.lit(0))).cast("int")
        return F.struct(
            F.lit(i).alias("_i"), F.when(inside, part).alias("_s"), F.when(inside, F.col("_v")).alias("_in"),
            F.when(F.col("_v") < lo, F.col("_v")).alias("_under"), F.when(F.col("_v") > hi, F.col("_v")).alias("_over"),
        )

    each = met.select(*keys, "n", F.inline(F.array(*[placed(i) for i in range(len(names))])))
    # all values outside a bracket become one row of each task before anything is shuffled
    counts = each.groupBy(*keys, "n", "_i", "_s", "_in").agg(
        F.count("_under").alias("_below"), F.count("_in").alias("_c"), F.max("_under").alias("_under"), F.min("_over").alias("_over")
    )
    group = Window.partitionBy(*keys, "_i")
    ahead = group.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    wish = rank(F.col("n")) if rank is not None else (F.col("n") - 1) * F.get(F.array(*[F.lit(a) for a in at]), F.col("_i"))
    ranks = (F.floor(wish), F.ceil(wish))
    slices = counts.groupBy(*keys, "n", "_i", "_s").agg(
        F.sum("_c").alias("_sc"), F.sum("_below").alias("_below"), F.max("_under").alias("_under"), F.min("_over").alias("_over")
    )
    slices = slices.withColumns({
        "_start": F.sum("_below").over(group) + F.coalesce(F.sum("_sc").over(ahead), F.lit(0)),
        "_end": F.sum("_below").over(group) + F.sum("_sc").over(group),
        "_first": F.sum("_below").over(group),
    })
    wanted = F.lit(False)
    for r in ranks:
        wanted = wanted | ((F.col("_start") <= r) & (r < F.col("_start") + F.col("_sc")))
    chosen = slices.filter(F.col("_s").isNotNull() & wanted).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_i").alias("_ki"), F.col("_s").alias("_ks"), "_start")
    on = (F.col("_i") == F.col("_ki")) & (F.col("_s") == F.col("_ks"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = Window.partitionBy(*keys, "_i", "_s").orderBy("_in").rowsBetween(Window.unboundedPreceding, 0)
    picked = counts.join(chosen, on).withColumn("_from", F.col("_start") + F.sum("_c").over(local) - F.col("_c"))
    columns = [*keys, "n", "_i"]
    spots = picked.select(*columns, F.col("_in").alias("_x"), "_from", (F.col("_from") + F.col("_c")).alias("_to"))
    edge = slices.filter(F.col("_s").isNull())
    spots = spots.unionByName(edge.where("_under IS NOT NULL").select(*columns, F.col("_under").alias("_x"), (F.col("_first") - 1).alias("_from"), F.col("_first").alias("_to")))
    spots = spots.unionByName(edge.where("_over IS NOT NULL").select(*columns, F.col("_over").alias("_x"), F.col("_end").alias("_from"), (F.col("_end") + 1).alias("_to")))
    ends = {}
    for i in range(len(names)):
        for side, r in zip(("lo", "hi"), ranks, strict=True):
            hit = (F.col("_i") == i) & (F.col("_from") <= r) & (r < F.col("_to"))
            ends[f"_{side}{i}"] = F.max(F.when(hit, F.col("_x")))
    out = spots.groupBy(*keys).agg(F.max("n").alias("n"), *[e.alias(name) for name, e in ends.items()]).where("n IS NOT NULL")
    missed = F.raise_error(F.lit("a rank lies outside its bracket"))

    def between(i: int) -> Column:
        r = rank(F.col("n")) if rank is not None else (F.col("n") - 1) * F.lit(at[i])
        lo, hi = (F.coalesce(F.col(f"_{side}{i}"), missed.cast("double")) for side in ("lo", "hi"))
        return lo + (hi - lo) * (r - F.floor(r))

    return out.select(*keys, "n", *[between(i).alias(name) for i, name in enumerate(names)])


def medians(df: DataFrame, keys: Sequence[str], value: str | Column, name: str = "median") -> DataFrame:
    """Exact median per key."""
    return quantiles(df, keys, value, {name: 0.5}).drop("n")


def with_medians(agg: DataFrame, df: DataFrame, keys: Sequence[str], columns: dict[str, Column | str]) -> DataFrame:
    """Attach exact medians ``{name: value}`` of ``df`` to an aggregate on the same keys; all columns in one pass."""
    if not columns:
        return agg
    keys = list(keys)
    value = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    if len(columns) == 1:
        [(name, column)] = columns.items()
        return agg.join(medians(df.select(*keys, value(column).alias("_x")), keys, "_x", name), keys, "left")
    cells = F.array(*[F.struct(F.lit(n).alias("_column"), value(c).alias("_x")) for n, c in columns.items()])
    found = medians(df.select(*keys, F.inline(cells)), [*keys, "_column"], "_x", "_median")
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_column") == n, F.col("_median"))).alias(n) for n in columns])
    return agg.join(wide, keys, "left")


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated once per row.

    A computed column used inside a lambda would otherwise be inlined into it and evaluated per
    element.
    """
    return F.get(F.transform(F.array(value), lambda v: fn(v)), F.lit(0))


def array_median(arr: Column) -> Column:
    """Median of one row's array, nulls skipped; null when nothing is left."""

    def middle(kept: Column) -> Column:
        n = F.size(kept)
        upper = F.get(kept, F.floor(n / 2).cast("int"))
        lower = F.get(kept, (F.floor((n + 1) / 2) - 1).cast("int"))
        return F.when(n > 0, (lower + upper) / 2)

    return let(F.array_sort(F.filter(arr, lambda x: x.isNotNull())), middle)
