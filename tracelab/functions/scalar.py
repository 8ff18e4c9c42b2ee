"""Cell-level functions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE = "yyyy-MM-dd'T'HH:mm"


def anscombe(x: Column, *, sigma_sq: float = 0.0, alpha: float = 1.0) -> Column:
    """Generalised Anscombe transform."""
    inner = x / alpha + F.lit(3.0 / 8.0 + sigma_sq / alpha**2)
    return F.lit(2.0) * F.sqrt(F.greatest(inner, F.lit(0.0)))


def anscombe_simple(x: Column) -> Column:
    """Counting form: ``2 sqrt(|x| + 3/8)``."""
    return F.lit(2.0) * F.sqrt(F.abs(x) + F.lit(3.0 / 8.0))


def inverse_anscombe(
    y: Column, *, sigma_sq: float = 0.0, mean: float = 0.0, alpha: float = 1.0, method: str = "closed-form"
) -> Column:
    """Unbiased inverse in closed form, or its asymptotic approximation."""
    noise = sigma_sq / alpha**2
    if method == "closed-form":
        t = F.greatest(y, F.lit(0.8))
        root = 1.5**0.5
        # fixed values: coefficients of the published closed-form inverse
        out = (
            t * t / 4.0
            + F.lit(0.25 * root) / t
            - F.lit(11.0 / 8.0) / (t * t)
            + F.lit(5.0 / 8.0 * root) / (t * t * t)
            - F.lit(1.0 / 8.0 + noise)
        )
    elif method == "asym":
        out = y * y / 4.0 - F.lit(1.0 / 8.0 + noise)
    else:
        raise ValueError(f"unknown method {method}")
    return out * F.lit(float(alpha)) + F.lit(float(mean))


def masked_log(x: Column) -> Column:
    """Natural log, 0 where ``x <= 0``."""
    return F.when(x.isNull(), None).when(x > 0, F.log(x)).otherwise(F.lit(0.0))


def log_anscombe(x: Column) -> Column:
    """Log of the counting Anscombe form."""
    return F.log(anscombe_simple(x))


def root(x: Column) -> Column:
    """Square root; null below zero (I4)."""
    return F.when(x >= 0, F.sqrt(x))


def unlog(x: Column) -> Column:
    """Inverse of the logarithm (I4)."""
    return F.exp(x)


def minute_text(ts: Column) -> Column:
    """``2024-01-31T23:59``."""
    return F.date_format(ts, MINUTE)


def day_first_text(ts: Column) -> Column:
    """``31/01/2024``."""
    return F.date_format(ts, "dd/MM/yyyy")


def epoch_of_minute(text: Column) -> Column:
    """Seconds since 1970 of a minute's text; null for anything else."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit(MINUTE)))


def magnitude(*axes: Column) -> Column:
    """Length of a vector."""
    total = axes[0] * axes[0]
    for a in axes[1:]:
        total = total + a * a
    return F.sqrt(total)


def round_to(x: Column, base: float) -> Column:
    """Nearest multiple of ``base`` (halves to even)."""
    return F.bround(x / F.lit(float(base))) * F.lit(float(base))


def floor_to(x: Column, base: float) -> Column:
    """Multiple of ``base`` at or below ``x``."""
    return F.floor(x / F.lit(float(base))) * F.lit(float(base))


def ceil_to(x: Column, base: float) -> Column:
    """Multiple of ``base`` at or above ``x``."""
    return F.ceil(x / F.lit(float(base))) * F.lit(float(base))


def elapsed_minutes(a: Column, b: Column) -> Column:
    """Whole minutes from ``a`` to ``b``, rounded up."""
    return F.ceil((F.unix_micros(b) - F.unix_micros(a)) / F.lit(60_000_000.0))


def calendar_difference(a: Column, b: Column) -> Column:
    """Struct of years, months, days, hours, minutes and seconds from ``a`` to a later ``b``."""
    rough = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)

    def shifted(m: Column) -> Column:
        return a + F.make_ym_interval(F.lit(0), m)

    months = F.when(shifted(rough) <= b, rough).otherwise(rough - 1)
    rest = F.unix_seconds(b) - F.unix_seconds(shifted(months))
    return F.struct(
        F.floor(months / 12).alias("years"),
        F.pmod(months, F.lit(12)).cast("long").alias("months"),
        F.floor(rest / 86400).alias("days"),
        F.floor(F.pmod(rest, F.lit(86400)) / 3600).alias("hours"),
        F.floor(F.pmod(rest, F.lit(3600)) / 60).alias("minutes"),
        F.pmod(rest, F.lit(60)).alias("seconds"),
    )


def elapsed_short(d: Column) -> Column:
    """``dd:hh:mm:ss`` of a calendar difference."""
    return F.format_string("%02d:%02d:%02d:%02d", d["days"], d["hours"], d["minutes"], d["seconds"])


def elapsed_long(d: Column) -> Column:
    """``y years m months …`` of a calendar difference."""
    text = "%d years %d months %d days %d hours %d minutes %d seconds"
    return F.format_string(text, *[d[k] for k in ("years", "months", "days", "hours", "minutes", "seconds")])


def same(unit: str, a: Column, b: Column) -> Column:
    """Both times fall in the same calendar unit (I8)."""
    return F.date_trunc(unit, a) == F.date_trunc(unit, b)


def weather_hour(text: Column) -> Column:
    """``0``, ``300``, ``1200`` → ``00:00``, ``03:00``, ``12:00``."""
    padded = F.lpad(text, 4, "0")
    return F.concat(F.left(padded, F.lit(2)), F.lit(":00"))


def parse_axes(text: Column) -> Column:
    """``xmin:ymin:zmin:xmax:ymax:zmax`` → struct of six integers, null unless six parts."""
    parts = F.split(text, ":")
    names = ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")
    fields = [F.element_at(parts, i + 1).try_cast("int").alias(n) for i, n in enumerate(names)]
    return F.when(F.size(parts) == 6, F.struct(*fields))


def tolerant_int(text: Column) -> Column:
    """Drop ``@``, keep what is before the point; -1 when it is no number."""
    head = F.split_part(F.replace(text, F.lit("@"), F.lit("")), F.lit("."), F.lit(1))
    return F.coalesce(head.try_cast("long"), F.lit(-1).cast("long"))


def digits_only(text: Column) -> Column:
    """The digits of a text as a number; -1 without any."""
    return F.coalesce(F.regexp_replace(text, "[^0-9]", "").try_cast("long"), F.lit(-1).cast("long"))


def tolerant_hex(text: Column) -> Column:
    """Hexadecimal text before the point; -1 when it is none."""
    head = F.split_part(text, F.lit("."), F.lit(1))
    return F.when(head.rlike("^[0-9a-fA-F]+$"), F.conv(head, 16, 10).cast("long")).otherwise(F.lit(-1).cast("long"))


def normalise_headers(df: DataFrame) -> DataFrame:
    """Trimmed lower-case column names without blanks, a known misspelling put right."""
    # fixed value: misspelt header
    wrong, right = "batteryife", "batterylife"
    return df.withColumnsRenamed({c: c.strip().lower().replace(" ", "").replace(wrong, right) for c in df.columns})


def clean_id(text: Column) -> Column:
    """Without quotes, up to the first point."""
    return F.split_part(F.replace(text, F.lit("'"), F.lit("")), F.lit("."), F.lit(1))


def farm_name(station: Column, names: Mapping[str, str]) -> Column:
    """Prefix a station id with its farm's name; unknown stations stay as they are."""
    text = station.cast("string")
    out = text
    for sid, name in names.items():
        out = F.when(text == sid, F.lit(f"{name}_{sid}")).otherwise(out)
    return out


def parse_list(text: Column) -> Column:
    """``"[0.1 0.2]"`` → array of doubles."""
    inner = F.trim(F.regexp_replace(text, r"[\[\]]", ""))
    return F.transform(F.split(inner, r"[,\s]+"), lambda s: s.try_cast("double"))


def path_part(path: Column, from_end: int, sep: str = "/") -> Column:
    """The ``from_end``-th component counted from the end."""
    return F.try_element_at(F.split(path, sep), F.lit(-from_end))


def mean_interval_text(mean: Column, low: Column, high: Column) -> Column:
    """``0.71 (0.60-0.80)``."""
    return F.format_string("%.2f (%.2f-%.2f)", mean, low, high)


def chunks(arr: Column, n: int) -> Column:
    """Array cut into pieces of ``n``."""
    starts = F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / n).cast("int"))
    return F.transform(starts, lambda i: F.slice(arr, i * n + 1, F.lit(n)))


def top_positions(arr: Column, k: int) -> Column:
    """0-based positions of the ``k`` largest values, largest first, later position first on ties."""
    tagged = F.transform(arr, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(tagged, asc=False), 1, k), lambda s: s["i"])


def explode_together(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Explode several list columns in step."""
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.explode(F.arrays_zip(*columns)).alias("_z")).select(
        *keep, *[F.col(f"_z.{c}").alias(c) for c in columns]
    )
