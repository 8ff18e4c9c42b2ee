"""Order-independent draws: a row's draw depends on its id and a seed only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 2**32


def draw(seed: int | str | Column, *ids: Column | str) -> Column:
    """A whole number in ``[0, 2**32)`` from the md5 of ``seed:id:...`` (portable across engines)."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [F.col(i) if isinstance(i, str) else i for i in ids]
    text = F.concat_ws(":", *[p.cast("string") for p in [first, *parts]])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def fraction(seed: int | str | Column, *ids: Column | str) -> Column:
    """The draw as a double in ``[0, 1)``."""
    return draw(seed, *ids) / F.lit(float(SPAN))


def draw_bucket(hashed: Column, buckets: int = 4096) -> Column:
    """Slice of the draw: hashes are even, so the slices are too."""
    return F.floor(hashed / F.lit(SPAN // buckets))
