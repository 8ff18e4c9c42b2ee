"""Unions, intersections and differences of datasets and id sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Datasets stacked by column name, each row knowing its source (G1)."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each row once, of all columns or of some."""
    return (df if columns is None else df.select(*columns)).distinct()


def common_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of both sets."""
    return a.intersect(b)


def missing_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct ids of ``a`` that ``b`` lacks."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")
