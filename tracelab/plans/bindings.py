"""How the given tables stand in for traces, visits, samples, predictions and runs.

Each role is a DataFrame function and the SQL text of the same common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.operators import grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; zone-less timestamps become UTC timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    casts = {
        f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)
    }
    return df.withColumns(casts) if casts else df


def r6(c: Column | str) -> Column:
    """Rounded to six places by plain double arithmetic, so that every engine agrees.

    The border lies a little below the half: a mean of 32 two-digit values may be an exact half.
    """
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.floor(x * F.lit(1e6) + F.lit(0.5003)) / F.lit(1e6)


def q6(expr: str) -> str:
    """The SQL side of :func:`r6`."""
    return f"(floor(({expr})::DOUBLE * 1e6 + 0.5003::DOUBLE) / 1e6)"


def secs(c: Column | str) -> Column:
    return F.unix_seconds(F.col(c) if isinstance(c, str) else c)


def qsecs(expr: str) -> str:
    return f"(epoch_us({expr}) // 1000000)::BIGINT"


# -- traces ------------------------------------------------------------------

S = "s AS (SELECT user_id AS series_id, ts, value, event_id, event_type AS kind FROM events)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("series_id"), "ts", "value", "event_id", F.col("event_type").alias("kind"))


HOURLY = (
    "h AS (SELECT user_id AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS value FROM events GROUP BY 1, 2),\n"
    "b AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM h GROUP BY 1),\n"
    "gg AS (SELECT series_id, lo, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM b),\n"
    "g AS (SELECT gg.series_id, gg.ts, date_diff('hour', gg.lo, gg.ts) AS pos, h.value"
    " FROM gg LEFT JOIN h ON h.series_id = gg.series_id AND h.ts = gg.ts)"
)


def hourly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums on each series' own regular grid; hours without a record are null."""
    return grid.regular_grid(grid.bucket_sum(series(spark, sf_dir), "1 hour"), "1 hour")


# -- visits ------------------------------------------------------------------

V = (
    "v AS (SELECT o_custkey AS series_id, o_orderkey AS visit_id, o_orderdate::DATE AS visit_date,"
    " left(o_orderpriority, 1)::INT AS score FROM orders)"
)


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("series_id"),
        F.col("o_orderkey").alias("visit_id"),
        F.to_date("o_orderdate").alias("visit_date"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("score"),
    )


VE = (
    "ve AS (SELECT user_id AS series_id, event_id AS visit_id, ts AS visit_ts,"
    " (1 + event_id % 5)::INT AS score, event_type AS kind FROM events)"
)


def visits_on_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits that share their ids with the traces: every event is one, its kind a column."""
    return series(spark, sf_dir).select(
        "series_id",
        F.col("event_id").alias("visit_id"),
        F.col("ts").alias("visit_ts"),
        (1 + F.col("event_id") % 5).cast("int").alias("score"),
        "kind",
    )


# -- samples -----------------------------------------------------------------

X = (
    "x AS (SELECT vec_id AS sample_id, label, (i - 1)::INT AS pos, embedding[i]::DOUBLE AS x"
    " FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("sample_id"), "label", F.col("embedding").cast("array<double>").alias("features")
    )


def long_features(df: DataFrame, *extra: str) -> DataFrame:
    """Samples as ``(sample_id, pos, x)`` rows, rounded for comparison."""
    return df.select("sample_id", *extra, F.posexplode("features").alias("pos", "x")).withColumn("x", r6("x"))


# -- predictions -------------------------------------------------------------

P = (
    "p AS (SELECT l.doc_id AS sample_id, (l.doc_id % 7)::INT AS series_id, d.source AS fold, l.quality AS y,"
    " d.n_chars::DOUBLE AS score, (d.n_chars > 400)::INT AS y_pred, l.toxic"
    " FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    p = table(spark, sf_dir, "labels").join(d, "doc_id")
    return p.select(
        F.col("doc_id").alias("sample_id"),
        (F.col("doc_id") % 7).cast("int").alias("series_id"),
        F.col("source").alias("fold"),
        F.col("quality").alias("y"),
        F.col("n_chars").cast("double").alias("score"),
        (F.col("n_chars") > 400).cast("int").alias("y_pred"),
        "toxic",
    )


# -- experiment reports ------------------------------------------------------

R = (
    "r AS (SELECT l_returnflag || '_' || l_linestatus || '_' || l_linenumber AS config, l_returnflag AS farm_id,"
    " l_linestatus AS method, l_linenumber AS fold, l_orderkey, l_discount * 10 AS auc, l_tax * 10 AS precision_1,"
    " l_quantity AS fit_time, l_extendedprice AS price, l_partkey, l_suppkey, l_shipdate FROM lineitem)"
)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("_", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("config"),
        F.col("l_returnflag").alias("farm_id"),
        F.col("l_linestatus").alias("method"),
        F.col("l_linenumber").alias("fold"),
        "l_orderkey",
        (F.col("l_discount") * 10).alias("auc"),
        (F.col("l_tax") * 10).alias("precision_1"),
        F.col("l_quantity").alias("fit_time"),
        F.col("l_extendedprice").alias("price"),
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
    )


# -- exogenous ---------------------------------------------------------------

WX = (
    "wx AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS temp_c, max(value) AS humidity"
    " FROM events GROUP BY 1)"
)


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        F.avg("value").alias("temp_c"), F.max("value").alias("humidity")
    )
