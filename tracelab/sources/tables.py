"""Sample files, exports, roll-up tables and experiment results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.operators.grid import RESOLUTIONS, rollups, zoom_resolution
from tracelab.operators.stats import class_counts

META = ("label", "id", "imputed_days", "date")
# each task puts its own files into place; otherwise the driver moves one folder per series after the other
BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
# on a local disk there is no checksum file beside each file: that is twice the files, and Hadoop sets permissions there by starting a process for each
BY_TASKS |= {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def write_tasks(df: DataFrame) -> int:
    """Tasks for a write whose cost is its number of files: a stated number, so that Spark does not merge them because their bytes are few."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write_traces(df: DataFrame, path: str) -> None:
    """Partitioned by farm, sorted by series and time within each file.

    Rows are spread by range over (farm, series, time), so that neither a big farm nor a big
    series ends up in one task.
    """
    spread = df.repartitionByRange("farm_id", "series_id", "ts").sortWithinPartitions("farm_id", "series_id", "ts")
    spread.write.mode("overwrite").partitionBy("farm_id").parquet(path)


def write_rollups(df: DataFrame, path: str, resolutions: Sequence[str] = RESOLUTIONS) -> None:
    """Every resolution of the records as one table partitioned by farm and resolution.

    A series seen in two farms is rolled up in each by itself.
    """
    rolled = rollups(df.withColumn("series_id", F.struct("farm_id", "series_id")), resolutions)
    rolled = rolled.withColumn("farm_id", F.col("series_id.farm_id")).withColumn("series_id", F.col("series_id.series_id"))
    spread = rolled.repartitionByRange("farm_id", "resolution", "series_id", "bucket")
    ordered = spread.sortWithinPartitions("farm_id", "resolution", "series_id", "bucket")
    ordered.write.mode("overwrite").partitionBy("farm_id", "resolution").parquet(path)


def zoom(spark: SparkSession, path: str, start: str, stop: str) -> DataFrame:
    """The roll-up rows of a time span at the resolution the span asks for.

    The resolution folds to a constant, so only that partition is read.
    """
    lo, hi = F.lit(start).cast("timestamp"), F.lit(stop).cast("timestamp")
    span = F.unix_seconds(hi) - F.unix_seconds(lo)
    table = spark.read.parquet(path)
    return table.filter((F.col("resolution") == zoom_resolution(span)) & F.col("bucket").between(lo, hi))


def write_samples(df: DataFrame, path: str, meta: Sequence[str] = META) -> None:
    """Headerless lines: features, then the metadata columns; class counts as JSON beside (A10)."""
    cells = F.transform("features", lambda x: F.coalesce(x.cast("string"), F.lit("")))
    line = F.concat_ws(",", F.array_join(cells, ","), *[F.coalesce(F.col(m).cast("string"), F.lit("")) for m in meta])
    df.select(line.alias("value")).write.mode("overwrite").text(f"{path}/samples")
    class_counts(df).write.mode("overwrite").json(f"{path}/classes")


def read_samples(spark: SparkSession, path: str, meta: Sequence[str] = META) -> DataFrame:
    """Headerless sample lines of any width; the last columns are metadata (A3)."""
    parts = F.split("value", ",", -1)
    n = len(meta)
    body = F.slice(parts, 1, F.size(parts) - n)
    return spark.read.text(path).select(
        F.transform(body, lambda x: x.try_cast("double")).alias("features"),
        *[F.element_at(parts, i - n).alias(m) for i, m in enumerate(meta)],
    )


def long_export(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``(id, time, variable, value)`` rows without repeats, the least value of each."""
    return df.unpivot(list(ids), list(values), "variable", "value").groupBy(*ids, "variable").agg(F.min("value").alias("value"))


def wide_export(df: DataFrame, series: Sequence[int]) -> DataFrame:
    """One column per stated series, one row per time; of repeated values the least."""
    wide = df.groupBy("ts").pivot("series_id", list(series)).agg(F.min("value"))
    return wide.orderBy("ts")


def write_per_series(df: DataFrame, path: str, names: dict[str, str]) -> None:
    """One folder per series with renamed columns (A13); rows are spread by range, so that a large series is written by several tasks."""
    renamed = df.withColumnsRenamed(names)
    renamed.repartitionByRange(write_tasks(df), "series_id", *[c for c in renamed.columns if c != "series_id"]).write.mode("overwrite").partitionBy("series_id").options(**BY_TASKS).option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: str, config: dict[str, str], *, lines: bool = True) -> DataFrame:
    """Result JSON below a folder, the configuration cut out of each path (A7): ``{column: pattern}``.

    ``lines``: one result per line; otherwise each file is one result, or a list of them, laid out over any number of lines.  What does not
    parse is an error.
    """
    raw = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return with_path_columns(raw.option("multiLine", not lines).option("mode", "FAILFAST").json(path), config)


def read_nested_results(spark: SparkSession, path: str, fields: dict[str, tuple[str, str]], config: dict[str, str], *, suffix: str = ".json") -> DataFrame:
    """One row per fold from result files of either layout, however printed.

    A file is one document: a fold, a list of folds, or an object with a list ``folds``.  ``fields`` gives each column the place of its value inside a fold and
    its type, lists included; what a fold lacks, or does not fit the type, is null.  ``config`` cuts columns out of the path.
    """
    raw = spark.read.option("recursiveFileLookup", True)
    raw = (raw.option("pathGlobFilter", f"*{suffix}") if suffix else raw).text(path, wholetext=True)
    read = with_path_columns(raw.withColumn("_v", F.parse_json("value")), config)
    listed = [F.try_variant_get("_v", place, "array<variant>") for place in ("$", "$.folds")]
    folds = F.explode(F.coalesce(*listed, F.array("_v"))).alias("_f")
    return read.select(*config, folds).select(*config, *[F.try_variant_get("_f", place, kind).alias(name) for name, (place, kind) in fields.items()])


def read_experiments(spark: SparkSession, path: str, schema: str, config: dict[str, str]) -> DataFrame:
    """Result CSV below a folder, tagged with the parameters in each path."""
    raw = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    return with_path_columns(raw, config)


def with_path_columns(df: DataFrame, config: dict[str, str]) -> DataFrame:
    path: Column = F.col("_metadata.file_path")
    return df.withColumns({name: F.regexp_extract(path, pattern, 1) for name, pattern in config.items()})


def merge_results(spark: SparkSession, pattern: str, schema: str, path: str, order: Sequence[str]) -> None:
    """Many result files with a header each → one ordered table.

    The files of the table are ranges of the order, so the merge needs no single writer.
    """
    df = spark.read.schema(schema).option("header", True).csv(pattern)
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    spread.write.mode("overwrite").option("header", True).csv(path)
