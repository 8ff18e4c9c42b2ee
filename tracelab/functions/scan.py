"""Ordered computations that stay balanced when one key owns most of the rows.

A plain window over ``key`` sorts the whole key in one task.  Everything here works on
``(key, bucket)`` instead, where ``bucket`` is a monotone function of the order (a day of a
timestamp, a block of grid positions, a slice of a hash).  What crosses a bucket border is a
few rows or one summary row per bucket, and only those are windowed over the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "_bucket"


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    values: dict[str, tuple[Column, int]],
) -> DataFrame:
    """Add ``lag``/``lead`` columns: ``{name: (expression, offset)}``, offset > 0 looks back.

    Rows further than ``k = max|offset|`` from both ends of their bucket are served inside the
    bucket.  The at most ``2k`` border rows per bucket are windowed again over the whole key:
    between a border row and its neighbour across the border lie only border rows, so the
    offset is the same there.
    """
    reach = max(abs(o) for _, o in values.values())
    local = Window.partitionBy(*keys, _B).orderBy(*_order(order))
    whole = Window.partitionBy(*keys).orderBy(*_order(order))
    exprs = {f"_v_{n}": e for n, (e, _) in values.items()}
    placed = (
        df.withColumns({**exprs, _B: bucket})
        .withColumns(
            {
                "_rn": F.row_number().over(local),
                "_size": F.count(F.lit(1)).over(Window.partitionBy(*keys, _B)),
                **{n: F.lag(f"_v_{n}", o).over(local) for n, (_, o) in values.items()},
            }
        )
        .withColumn("_back", F.col("_size") - F.col("_rn") + 1)
    )
    border = (F.col("_rn") <= reach) | (F.col("_back") <= reach)
    out = df.columns + [n for n in values if n not in df.columns]
    inner = placed.filter(~border).select(*out)
    served = {
        n: F.when(F.col("_rn") > o if o > 0 else F.col("_back") > -o, F.col(n)).otherwise(
            F.lag(f"_v_{n}", o).over(whole)
        )
        for n, (_, o) in values.items()
    }
    return inner.unionByName(placed.filter(border).withColumns(served).select(*out))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    *,
    last: dict[str, Column] | None = None,
    prior: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    cumsum: dict[str, Column] | None = None,
    cummin: dict[str, Column] | None = None,
    whole: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Running values along ``order`` within ``keys``.

    ``last``: latest non-null value at or before the row; ``prior``: strictly before it;
    ``following``: first non-null value at or after the row; ``cumsum``/``cummin``: running
    sum/minimum; ``whole``: ``{name: ('min' | 'max' | 'sum', expression)}`` over all of the key.
    One summary row per bucket is windowed over the key and joined back on the same
    ``(key, bucket)`` partitioning the local windows already use.
    """
    last, prior, following = last or {}, prior or {}, following or {}
    cumsum, cummin, whole = cumsum or {}, cummin or {}, whole or {}
    specs = {**last, **prior, **following, **cumsum, **cummin, **{n: e for n, (_, e) in whole.items()}}
    fold = {"min": F.min, "max": F.max, "sum": F.sum}
    ordering = _order(order)
    # one plain column aggregates by hash, a struct only by sort
    stamp = ordering[0] if len(ordering) == 1 else F.struct(*ordering)
    tagged = df.withColumns({**{f"_v_{n}": e for n, e in specs.items()}, _B: bucket})

    def known(n: str) -> Column:
        return F.when(F.col(f"_v_{n}").isNotNull(), stamp)

    summary = tagged.groupBy(*keys, _B).agg(
        *[F.max_by(f"_v_{n}", known(n)).alias(f"_s_{n}") for n in [*last, *prior]],
        *[F.min_by(f"_v_{n}", known(n)).alias(f"_s_{n}") for n in following],
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in cumsum],
        *[F.min(f"_v_{n}").alias(f"_s_{n}") for n in cummin],
        *[fold[how](f"_v_{n}").alias(f"_s_{n}") for n, (how, _) in whole.items()],
    )
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col(_B).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys,
        _B,
        *[F.last(f"_s_{n}", True).over(before).alias(f"_c_{n}") for n in [*last, *prior]],
        *[F.last(f"_s_{n}", True).over(after).alias(f"_c_{n}") for n in following],
        *[F.sum(f"_s_{n}").over(before).alias(f"_c_{n}") for n in cumsum],
        *[F.min(f"_s_{n}").over(before).alias(f"_c_{n}") for n in cummin],
        *[fold[how](f"_s_{n}").over(Window.partitionBy(*keys)).alias(f"_c_{n}") for n, (how, _) in whole.items()],
    )
    base = Window.partitionBy(*keys, _B)
    fwd = base.orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0)
    fwd_open = base.orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1)
    back = base.orderBy(*[o.desc() for o in ordering]).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumns(
        {
            **{f"_l_{n}": F.last(f"_v_{n}", True).over(fwd) for n in last},
            **{f"_l_{n}": F.last(f"_v_{n}", True).over(fwd_open) for n in prior},
            **{f"_l_{n}": F.last(f"_v_{n}", True).over(back) for n in following},
            **{f"_l_{n}": F.sum(f"_v_{n}").over(fwd) for n in cumsum},
            **{f"_l_{n}": F.min(f"_v_{n}").over(fwd) for n in cummin},
        }
    )
    joined = local.join(carry, [*keys, _B], "left")
    result = {n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in [*last, *prior, *following]}
    for n in whole:
        result[n] = F.col(f"_c_{n}")
    for n in cummin:
        result[n] = F.least(f"_l_{n}", f"_c_{n}")
    for n in cumsum:
        zero = F.lit(0)
        result[n] = F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_c_{n}"), zero)
    return joined.withColumns(result).select(*df.columns, *[n for n in specs if n not in df.columns])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "rn") -> DataFrame:
    """``row_number`` within ``keys`` (``order`` must be total)."""
    return scan(df, keys, order, bucket, cumsum={name: F.lit(1).cast("long")})


def runs(df: DataFrame, keys: Sequence[str], pos: str, flag: Column, block: int, *, end: str | None = None) -> DataFrame:
    """Gaps and islands of a non-null boolean on a grid of consecutive positions.

    Adds ``run_start``, ``run_end`` and ``run_len``, and the key's last position as ``end``.  A run of one value lies between the nearest
    rows of the other value, so one pass that carries both kinds of position finds its ends.
    """
    here = F.col(pos)
    found = scan(
        df.withColumn("_flag", flag),
        keys,
        [pos],
        F.floor(here / block),
        last={"_on": F.when(F.col("_flag"), here), "_off": F.when(~F.col("_flag"), here)},
        following={"_on2": F.when(F.col("_flag"), here), "_off2": F.when(~F.col("_flag"), here)},
        whole={"_first": ("min", here), "_end": ("max", here)},
    )
    before = F.when(F.col("_flag"), F.col("_off")).otherwise(F.col("_on"))
    after = F.when(F.col("_flag"), F.col("_off2")).otherwise(F.col("_on2"))
    return (
        found.withColumns(
            {
                "run_start": F.coalesce(before + 1, F.col("_first")),
                "run_end": F.coalesce(after - 1, F.col("_end")),
            }
        )
        .withColumn("run_len", F.col("run_end") - F.col("run_start") + 1)
        .withColumns({end: F.col("_end")} if end else {})
        .drop("_flag", "_on", "_off", "_on2", "_off2", "_first", "_end")
    )


def with_halo(df: DataFrame, pos: str, block: int, before: int) -> DataFrame:
    """Cut a grid into blocks of ``block`` positions plus the ``before`` positions ahead of each.

    Adds ``block`` and ``home`` (the row belongs to the block rather than to its lead-in), so a
    frame of ``before`` preceding rows is complete inside ``(key, block)``.
    """
    first = F.floor(F.col(pos) / block)
    reach = F.floor((F.col(pos) + before) / block)
    return df.withColumn("block", F.explode(F.sequence(first, reach))).withColumn(
        "home", F.col("block") == F.floor(F.col(pos) / block)
    )
