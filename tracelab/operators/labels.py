"""Scores over time: transitions, gaps between visits, classes and targets.

Visits are ``(series_id, visit_id, visit_date, score)``; ``visit_id`` breaks ties of a day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.scan import neighbours, ranked, scan

KEY = ["series_id"]
ORDER = ["visit_date", "visit_id"]


def visit_day(c: str = "visit_date") -> Column:
    """Monotone bucket for ordered scans over visits: the day number, so that a series with very many visits is cut finely."""
    return F.unix_date(F.to_date(c)).cast("long")


def transition(prev: Column, curr: Column) -> Column:
    """``1To2``."""
    return F.when(prev.isNotNull() & curr.isNotNull(), F.concat(prev.cast("string"), F.lit("To"), curr.cast("string")))


def transition_code(prev: Column, curr: Column) -> Column:
    """``prev * 10 + curr`` (I16)."""
    return prev * 10 + curr


def label_from_code(code: Column) -> Column:
    return transition(F.floor(code / 10).cast("int"), F.pmod(code, F.lit(10)).cast("int"))


def previous_scores(visits: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` scores before each visit and the transition label."""
    lags = {f"prev{i}": (F.col("score"), i) for i in range(1, k + 1)}
    out = neighbours(visits, KEY, ORDER, visit_day(), lags)
    return out.withColumn("label", transition(F.col("prev1"), F.col("score")))


def next_visits(visits: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` visit dates after each visit and the day gaps between successive ones."""
    leads = {f"date{i}": (F.col("visit_date"), -i) for i in range(1, k + 1)}
    out = neighbours(visits, KEY, ORDER, visit_day(), leads)
    dates = ["visit_date", *leads]
    return out.withColumns({f"gap{i}": F.datediff(dates[i], dates[i - 1]) for i in range(1, k + 1)})


def minimum_gap(visits: DataFrame) -> DataFrame:
    """Smallest day gap between consecutive visits per series."""
    return next_visits(visits, 1).groupBy(*KEY).agg(F.min("gap1").alias("min_gap"))


def change_class(prev: Column, curr: Column) -> Column:
    """Five-way class of a score change."""
    return (
        F.when((prev == 1) & (curr >= 2), 1)
        .when((prev >= 2) & (curr == 1), 2)
        .when((prev == 2) & (curr == 2), 3)
        .when((prev == 1) & (curr == 1), 4)
        .when((prev > 2) & (curr > 2), 5)
    )


def change_flags(visits: DataFrame) -> DataFrame:
    """Went up from 1 / stayed at 1, sign of the change, and the five-way class."""
    prev, curr = F.col("prev1"), F.col("score")
    return previous_scores(visits, 1).withColumns(
        {
            "increase": F.when((prev == 1) & (curr >= 2), 1).when((prev == 1) & (curr == 1), 0),
            "direction": F.signum((curr - prev).cast("double")).cast("int"),
            "change": change_class(prev, curr),
        }
    )


def consecutive_mask(visits: DataFrame, days: int = 7) -> DataFrame:
    """Visits inside two successive gaps of exactly ``days``."""
    spread = {
        "_before": (F.col("visit_date"), 1),
        "_next": (F.col("visit_date"), -1),
        "_next2": (F.col("visit_date"), -2),
    }
    out = neighbours(visits, KEY, ORDER, visit_day(), spread)
    gap = F.datediff("_next", "visit_date") == days
    gap_before = F.datediff("visit_date", "_before") == days
    gap_after = F.datediff("_next2", "_next") == days
    mask = F.coalesce((gap & gap_after) | (gap_before & gap), F.lit(False))
    return out.withColumn("consecutive", mask).drop(*spread)


def chain_pattern(visits: DataFrame, pattern: Sequence[str], days: int) -> DataFrame:
    """Successive visits with these labels, ``days`` apart, joined into one longer sample.

    ``visits`` carries ``label``, ``features`` and ``imputed_days``.
    """
    n = len(pattern)
    cols: dict[str, tuple[Column, int]] = {}
    for i in range(1, n):
        for c in ("label", "visit_date", "visit_id", "imputed_days"):
            cols[f"_{c}{i}"] = (F.col(c), -i)
    out = neighbours(visits.select(*KEY, *ORDER, "label", "imputed_days"), KEY, ORDER, visit_day(), cols)

    def at(c: str, i: int) -> Column:
        return F.col(c) if i == 0 else F.col(f"_{c}{i}")

    hit = F.lit(True)
    for i, wanted in enumerate(pattern):
        hit = hit & (at("label", i) == wanted)
        if i:
            hit = hit & (F.datediff(at("visit_date", i), at("visit_date", i - 1)) == days)
    total = at("imputed_days", 0)
    for i in range(1, n):
        total = total + at("imputed_days", i)
    hits = out.filter(hit).select(*KEY, "visit_id", "visit_date", total.alias("imputed_days"), *[at("visit_id", i).alias(f"_v{i}") for i in range(n)])
    # features are fetched for the visits of hits alone
    parts = hits.select(*KEY, F.col("visit_id").alias("_of"), "visit_date", "imputed_days", F.posexplode(F.array(*[f"_v{i}" for i in range(n)])).alias("_i", "visit_id"))
    told = parts.join(visits.select(*KEY, "visit_id", "features"), [*KEY, "visit_id"])
    ordered = F.sort_array(F.collect_list(F.struct("_i", "features")))
    return told.groupBy(*KEY, F.col("_of").alias("visit_id"), "visit_date", "imputed_days").agg(F.flatten(F.transform(ordered, lambda p: p["features"])).alias("features")).select(
        *KEY, "visit_id", "visit_date", "features", "imputed_days"
    )


def halves(visits: DataFrame) -> DataFrame:
    """First half by date against the rest, per series."""
    one = F.lit(1).cast("long")
    out = scan(visits, KEY, ORDER, visit_day(), cumsum={"rn": one}, whole={"n": ("sum", one)})
    return out.withColumn("half", F.when(F.col("rn") <= F.floor(F.col("n") / 2), 1).otherwise(2))


def binary_health(label: Column, healthy: Sequence[str], unhealthy: Sequence[str]) -> Column:
    """0 healthy, 1 unhealthy, -1 anything else."""
    return F.when(label.isin(*healthy), 0).when(label.isin(*unhealthy), 1).otherwise(-1)


def with_dense_target(df: DataFrame, label: str = "label", name: str = "target") -> DataFrame:
    """1-based number of the label in sorted order, null for a null label (B12); the labels are numbered as a table of their own."""
    domain = df.select(F.col(label).alias("_label")).where(F.col(label).isNotNull()).distinct().withColumn("_all", F.lit(0))
    numbered = ranked(domain, ["_all"], ["_label"], F.ascii(F.col("_label").cast("string")), name).drop("_all")
    return df.join(numbered, F.col(label) == F.col("_label"), "left").drop("_label")


def one_hot(df: DataFrame, labels: Sequence[str], label: str = "label") -> DataFrame:
    """One 0/1 column per label of a stated domain."""
    return df.withColumns({f"is_{v}": (F.col(label) == v).cast("int") for v in labels})


def season(date: Column) -> Column:
    """1 winter … 4 autumn."""
    return (F.floor(F.pmod(F.month(date), F.lit(12)) / 3) + 1).cast("int")


def day_or_night(ts: Column) -> Column:
    """Hours 6 to 18 are Day."""
    return F.when(F.hour(ts).between(6, 18), "Day").otherwise("Night")


def light_phase(
    second_of_day: Column, sunrise_min: Column, sunrise_max: Column, sunset_min: Column, sunset_max: Column
) -> Column:
    """Night, transit or day from four sun times."""
    inner = (second_of_day >= sunrise_max) & (second_of_day < sunset_min)
    outer = (second_of_day >= sunrise_min) & (second_of_day < sunset_max)
    level = inner.cast("int") + outer.cast("int")
    return F.when(level == 2, "day").when(level == 1, "transit").otherwise("night")


def binary_target(target: Column, healthy: int) -> Column:
    """``target != healthy``."""
    return (target != healthy).cast("int")


def transition_direction(label: Column) -> Column:
    """Equal, up or down from the label's first and last character."""
    first, last = F.left(label, F.lit(1)), F.right(label, F.lit(1))
    return F.when(first == last, "equal").when(first < last, "up").otherwise("down")
