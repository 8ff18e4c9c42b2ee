"""Reading traces, score files, weather and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.functions.scalar import weather_hour

TRACE = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("date_str", T.StringType()),
        T.StructField("first_sensor_value", T.DoubleType()),
        T.StructField("signal_strength", T.IntegerType()),
        T.StructField("battery_voltage", T.IntegerType()),
    ]
)
SCORES = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
WEATHER = "data STRUCT<weather: ARRAY<STRUCT<date: STRING, hourly: ARRAY<STRUCT<time: STRING, humidity: STRING, tempC: STRING>>>>>"


def read_traces(spark: SparkSession, path: str, *, id_pattern: str = r"(\d+)[^/]*$", schema: T.StructType = TRACE) -> DataFrame:
    """Every trace file below a folder as one long table, the id taken from the path (A1).

    Derived files (``median…``, ``mean…``) are left out by name (A2).
    """
    raw = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    named = raw.withColumns({"_path": F.col("_metadata.file_path"), "_name": F.col("_metadata.file_name")})
    own = named.filter(~F.col("_path").rlike(r"/(median|mean)[^/]*(/[^/]*)?$"))
    return own.select(
        F.regexp_extract("_path", id_pattern, 1).cast("long").alias("series_id"),
        F.timestamp_seconds("timestamp").alias("ts"),
        F.col("first_sensor_value").alias("value"),
        "signal_strength",
        "battery_voltage",
    )


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """``{id: {dd/MM/yyyy: score}}`` files → ``(series_id, visit_date, score)`` (A4)."""
    docs = spark.read.text(path).select(F.from_json("value", SCORES).alias("m"))
    per = docs.select(F.explode("m").alias("series_id", "visits"))
    return per.select(F.col("series_id").cast("long"), F.explode("visits").alias("d", "score")).select(
        "series_id", F.to_date("d", "dd/MM/yyyy").alias("visit_date"), F.col("score").cast("int").alias("score")
    )


def read_weather_json(spark: SparkSession, path: str) -> DataFrame:
    """One API response per line → hourly rows (A5)."""
    raw = spark.read.schema(WEATHER).json(path)
    days = raw.select(F.explode("data.weather").alias("d"))
    hours = days.select(F.to_date("d.date").alias("date"), F.explode("d.hourly").alias("h"))
    return hours.select(
        "date",
        weather_hour(F.col("h.time")).alias("time"),
        F.col("h.humidity").try_cast("double").alias("humidity"),
        F.col("h.tempC").try_cast("double").alias("temp_c"),
    )


def read_weather_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Hourly weather files with a header, stacked by column name."""
    schema = "datetime TIMESTAMP, temp_c DOUBLE, humidity DOUBLE"
    out = None
    for p in paths:
        df = spark.read.schema(schema).option("header", True).csv(p)
        out = df if out is None else out.unionByName(df)
    return out.select(
        F.date_format("datetime", "yyyy-MM-dd").alias("date"), F.date_format("datetime", "HH:00").alias("time"), "temp_c", "humidity"
    )


def ordered_fixes(raw: DataFrame, *, lat: Column, lon: Column, alt: Column, ts: Column) -> DataFrame:
    """Position fixes in order of time, unparsable rows dropped."""
    fixes = raw.select(
        ts.try_cast("timestamp").alias("ts"),
        lat.try_cast("double").alias("lat"),
        lon.try_cast("double").alias("lon"),
        alt.try_cast("double").alias("alt"),
    )
    return fixes.dropna().orderBy("ts", "lat", "lon")
