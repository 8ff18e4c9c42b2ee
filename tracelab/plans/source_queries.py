"""Queries that write derived tables to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.operators import models, splits
from tracelab.plans.bindings import HOURLY, P, R, S, V, X, hourly_grid, long_features, predictions, q6, qsecs, r6, reports, samples, secs, series, visits, weather
from tracelab.plans.registry import query
from tracelab.plans.result_queries import _folds
from tracelab.plans.trace_queries import _ROLL_OUT, REC, ROLL_ALL, records, roll_out, sql_draw
from tracelab.plans.visit_queries import day_text, qday
from tracelab.session import scratch_path
from tracelab.sources import tables, traces

_TRACE_SQL = (
    f"WITH {REC} SELECT series_id, {qsecs('ts')} AS ts_s, {q6('value')} AS value, signal_strength, battery_voltage FROM rec"
)


def _trace_out(df):
    return df.select("series_id", secs("ts").alias("ts_s"), r6("value").alias("value"), "signal_strength", "battery_voltage")


def _write_trace_files(spark, sf):
    path = scratch_path(spark, "traces")
    rec = records(spark, sf).select(
        "series_id",
        F.unix_seconds("ts").alias("timestamp"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("date_str"),
        F.col("value").alias("first_sensor_value"),
        "signal_strength",
        "battery_voltage",
    )
    rec.repartitionByRange(tables.write_tasks(rec), "series_id", "timestamp").write.partitionBy("series_id").options(**tables.BY_TASKS).option("header", True).csv(path)
    return path, rec


@query("a1_trace_files", _TRACE_SQL)
def _(spark, sf):
    path, _rec = _write_trace_files(spark, sf)
    return _trace_out(traces.read_traces(spark, path, id_pattern=r"series_id=(\d+)/"))


@query("a2_derived_files_skipped", _TRACE_SQL)
def _(spark, sf):
    path, rec = _write_trace_files(spark, sf)
    rec.drop("series_id").write.option("header", True).csv(f"{path}/median_1")
    rec.drop("series_id").write.option("header", True).csv(f"{path}/mean_1")
    return _trace_out(traces.read_traces(spark, path, id_pattern=r"series_id=(\d+)/"))


def _sample_files(spark, sf):
    path = scratch_path(spark, "samples")
    x = samples(spark, sf).withColumns(
        {
            "id": F.col("sample_id"),
            "imputed_days": F.col("sample_id") % 7,
            "date": F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("sample_id") % 30).cast("int")), "dd/MM/yyyy"),
            "valid": F.col("sample_id") % 3 != 0,
            "label": F.concat(F.lit("c"), F.col("label").cast("string")),
        }
    )
    tables.write_samples(x, path)
    return path


@query(
    "a3_sample_file",
    f"WITH {X} SELECT sample_id, 'c' || label AS label, sample_id % 7 AS imputed_days, {qday('DATE ' + chr(39) + '2024-01-01' + chr(39) + ' + (sample_id % 30)::INT')} AS date,"
    f" pos, {q6('x')} AS x FROM x",
)
def _(spark, sf):
    back = tables.read_samples(spark, f"{_sample_files(spark, sf)}/samples")
    typed = back.select(
        F.col("id").cast("long").alias("sample_id"),
        "label",
        F.col("imputed_days").cast("long").alias("imputed_days"),
        day_text(F.to_date("date", "dd/MM/yyyy")).alias("date"),
        "features",
    )
    return long_features(typed, "label", "imputed_days", "date")


@query(
    "a10_class_count_file",
    "WITH k AS (SELECT 'c' || label AS label, vec_id % 3 != 0 AS valid FROM embeddings) SELECT coalesce(label, 'total') AS label, count(*) FILTER (valid) AS valid,"
    " count(*) FILTER (NOT valid) AS not_valid, count(*) AS total FROM k GROUP BY ROLLUP (label)",
)
def _(spark, sf):
    path = _sample_files(spark, sf)
    return spark.read.schema("label STRING, valid BIGINT, not_valid BIGINT, total BIGINT").json(f"{path}/classes")


@query(
    "a4_score_files",
    f"WITH {V} SELECT series_id, {qday('visit_date')} AS day, arg_max(score, visit_id) AS score FROM v GROUP BY series_id, visit_date",
)
def _(spark, sf):
    path = scratch_path(spark, "scores")
    day = F.date_format("visit_date", "dd/MM/yyyy").alias("d")
    last = visits(spark, sf).groupBy("series_id", day).agg(F.max_by("score", "visit_id").cast("double").alias("s"))
    per = last.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("d", "s"))).alias("m"))
    doc = F.to_json(F.create_map(F.col("series_id").cast("string"), "m"))
    per.select(doc.alias("value")).write.text(path)
    return traces.read_scores(spark, path).select("series_id", day_text("visit_date").alias("day"), "score")


_WX_OUT = (
    "WITH wx AS (SELECT date_trunc('hour', ts) AS hour, floor(avg(value)) AS temp_c, floor(max(value)) AS humidity FROM events GROUP BY 1)"
    f" SELECT {qday('hour')} AS date, strftime(hour, '%H:00') AS time, {q6('temp_c')} AS temp_c, {q6('humidity')} AS humidity FROM wx"
)


def _hours(spark, sf):
    return weather(spark, sf).withColumns({"temp_c": F.floor("temp_c"), "humidity": F.floor("humidity")})


@query("a5_weather_json", _WX_OUT)
def _(spark, sf):
    path = scratch_path(spark, "weather-json")
    hour = F.struct(
        (F.hour("hour") * 100).cast("string").alias("time"),
        F.col("humidity").cast("string").alias("humidity"),
        F.col("temp_c").cast("string").alias("tempC"),
    )
    days = _hours(spark, sf).groupBy(day_text("hour").alias("date")).agg(F.collect_list(hour).alias("hourly"))
    body = F.struct(F.struct(F.array(F.struct("date", "hourly")).alias("weather")).alias("data"))
    days.select(F.to_json(body).alias("value")).write.text(path)
    out = traces.read_weather_json(spark, path)
    return out.select(day_text("date").alias("date"), "time", r6("temp_c").alias("temp_c"), r6("humidity").alias("humidity"))


@query("a6_weather_csv", _WX_OUT)
def _(spark, sf):
    path = scratch_path(spark, "weather-csv")
    h = _hours(spark, sf).select(F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"), "temp_c", "humidity")
    early = F.col("datetime") < "2024-01-15"
    h.filter(early).write.option("header", True).csv(f"{path}/a")
    h.filter(~early).write.option("header", True).csv(f"{path}/b")
    out = traces.read_weather_csv(spark, f"{path}/a", f"{path}/b")
    return out.select("date", "time", r6("temp_c").alias("temp_c"), r6("humidity").alias("humidity"))


_RES_SQL = f"WITH {R} SELECT farm_id, method, fold, count(*) AS n, {q6('avg(price)')} AS price FROM r GROUP BY 1, 2, 3"


def _results(spark, sf):
    r = reports(spark, sf).groupBy("farm_id", "method", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("price"))
    return r


_CONFIG = {"farm_id": r"/farm=([^/]+)/", "method": r"/method=([^/]+)/"}


@query("a7_result_json", _RES_SQL)
def _(spark, sf):
    path = scratch_path(spark, "results-json")
    _results(spark, sf).withColumnRenamed("farm_id", "farm").write.partitionBy("farm", "method").json(path)
    out = tables.read_results(spark, path, "fold INT, n BIGINT, price DOUBLE", _CONFIG)
    return out.withColumn("price", r6("price"))


_FOLD_SQL = (
    f"WITH {P} SELECT fold AS run, 7::BIGINT AS days, 'qn' AS steps, series_id AS fold, count(*) AS n_test, sum(y)::BIGINT AS positives, {q6('avg(score)')} AS score"
    " FROM p WHERE y IS NOT NULL GROUP BY fold, series_id"
)


@query("a7_nested_folds", _FOLD_SQL)
def _(spark, sf):
    path = scratch_path(spark, "results-nested")
    p = predictions(spark, sf).where(F.col("y").isNotNull())
    each = p.groupBy("fold", "series_id").agg(
        F.avg("score").alias("score"), F.transform(F.sort_array(F.collect_list(F.struct("sample_id", "y"))), lambda s: s["y"]).alias("y_test")
    )
    one = F.struct(F.col("series_id").alias("fold"), F.struct("score").alias("metrics"), "y_test")
    pretty = {"pretty": "true"}
    run = F.concat(F.lit("run_"), "fold", F.lit("__7_qn"))
    # runs of an odd name length are one file per fold, the others one file with all folds
    odd = F.length("fold") % 2 == 1
    each.where(odd).select(run.alias("config"), F.col("series_id").alias("part"), F.to_json(one, pretty).alias("value")).write.partitionBy("config", "part").option("compression", "none").text(f"{path}/single")
    every = each.where(~odd).groupBy("fold").agg(F.collect_list(one).alias("folds"))
    every.select(run.alias("config"), F.to_json(F.struct("folds"), pretty).alias("value")).write.partitionBy("config").text(f"{path}/all")
    out = tables.read_nested_results(
        spark, path, {"fold": ("$.fold", "int"), "score": ("$.metrics.score", "double"), "y_test": ("$.y_test", "array<int>")},
        {"run": r"config=run_(.+?)__", "days": r"__(\d+)_", "steps": r"__\d+_([^/_]+)"}, suffix="",
    )
    positives = F.aggregate("y_test", F.lit(0).cast("long"), lambda a, y: a + y)
    return out.select("run", F.col("days").cast("long").alias("days"), "steps", "fold", F.size("y_test").cast("long").alias("n_test"), positives.alias("positives"), r6("score").alias("score"))


@query("a8_experiment_csv", _RES_SQL)
def _(spark, sf):
    path = scratch_path(spark, "results-csv")
    _results(spark, sf).withColumnRenamed("farm_id", "farm").write.partitionBy("farm", "method").option("header", True).csv(path)
    out = tables.read_experiments(spark, path, "fold INT, n BIGINT, price DOUBLE", _CONFIG)
    return out.withColumn("price", r6("price"))


@query("a15_merged_results", _RES_SQL)
def _(spark, sf):
    path = scratch_path(spark, "merge")
    # one job writes a folder of files per method; the method stays a column of the files as well
    _results(spark, sf).withColumn("part", F.col("method")).write.partitionBy("part").option("header", True).csv(f"{path}/in")
    schema = "farm_id STRING, method STRING, fold INT, n BIGINT, price DOUBLE"
    tables.merge_results(spark, f"{path}/in/part=*", schema, f"{path}/out", ["farm_id", "method", "fold"])
    out = spark.read.schema(schema).option("header", True).csv(f"{path}/out")
    return out.withColumn("price", r6("price"))


@query("a9_traces_by_farm", f"WITH {S} SELECT series_id, event_id, (series_id % 4)::INT AS farm_id, {q6('value')} AS value FROM s")
def _(spark, sf):
    path = scratch_path(spark, "farms")
    farm = (F.col("series_id") % 4).cast("int")
    tables.write_traces(series(spark, sf).withColumn("farm_id", farm), path)
    return spark.read.parquet(path).select("series_id", "event_id", "farm_id", r6("value").alias("value"))


@query(
    "a12_long_export",
    f"WITH {REC}, h AS (SELECT series_id, date_trunc('hour', ts) AS ts, max(signal_strength) AS signal_strength, max(battery_voltage) AS battery_voltage FROM rec GROUP BY 1, date_trunc('hour', ts))"
    f" SELECT series_id, {qsecs('ts')} AS ts_s, variable, value FROM (UNPIVOT h ON signal_strength, battery_voltage INTO NAME variable VALUE value)",
)
def _(spark, sf):
    h = records(spark, sf).groupBy("series_id", F.date_trunc("hour", "ts").alias("ts")).agg(
        F.max("signal_strength").alias("signal_strength"), F.max("battery_voltage").alias("battery_voltage")
    )
    out = tables.long_export(h, ["series_id", "ts"], ["signal_strength", "battery_voltage"])
    return out.select("series_id", secs("ts").alias("ts_s"), "variable", "value")


@query(
    "a12_wide_export",
    f"WITH {HOURLY}, k AS (SELECT (series_id % 5)::INT AS series_id, date_trunc('day', ts) AS ts, sum(value) AS value FROM g GROUP BY 1, date_trunc('day', ts)) SELECT {qsecs('ts')} AS ts_s, "
    + ", ".join(f"{q6(f'max(value) FILTER (series_id = {i})')} AS s{i}" for i in range(5))
    + " FROM k GROUP BY ts",
)
def _(spark, sf):
    herd_of = (F.col("series_id") % 5).cast("int").alias("series_id")
    k = hourly_grid(spark, sf).groupBy(herd_of, F.date_trunc("day", "ts").alias("ts")).agg(F.sum("value").alias("value"))
    out = tables.wide_export(k, range(5))
    return out.select(secs("ts").alias("ts_s"), *[r6(str(i)).alias(f"s{i}") for i in range(5)])


@query("a13_file_per_series", f"WITH {S} SELECT series_id, event_id, {q6('value')} AS activity FROM s")
def _(spark, sf):
    path = scratch_path(spark, "per-series")
    tables.write_per_series(series(spark, sf).select("series_id", "event_id", "value"), path, {"value": "activity"})
    out = spark.read.schema("event_id BIGINT, activity DOUBLE, series_id BIGINT").option("header", True).csv(path)
    return out.withColumn("activity", r6("activity"))


def _rollup_table(spark, sf):
    path = scratch_path(spark, "rollups")
    farm = (F.col("series_id") % 4).cast("int")
    tables.write_rollups(records(spark, sf).withColumn("farm_id", farm), path)
    return path


@query("a14_rollup_tables", f"WITH {REC}, x AS ({ROLL_ALL}) {_ROLL_OUT}, resolution, (series_id % 4)::INT AS farm_id FROM x")
def _(spark, sf):
    return roll_out(spark.read.parquet(_rollup_table(spark, sf)), "resolution", "farm_id")


@query(
    "t18_zoom",
    f"WITH {REC}, x AS ({ROLL_ALL}) {_ROLL_OUT} FROM x WHERE resolution = '10 minutes' AND bucket BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-23 12:00:00'",
)
def _(spark, sf):
    return roll_out(tables.zoom(spark, _rollup_table(spark, sf), "2024-01-03 00:00:00", "2024-01-23 12:00:00"))


@query(
    "m27_gps_fixes",
    f"SELECT {qsecs('ts')} AS ts_s, {q6('user_id / 10.0::DOUBLE')} AS lat, {q6('value')} AS lon, {q6('event_id')} AS alt FROM events WHERE event_id % 11 != 0 AND event_id % 13 != 0",
)
def _(spark, sf):
    e = series(spark, sf)
    bad_lat, bad_time = F.col("event_id") % 11 == 0, F.col("event_id") % 13 == 0
    out = traces.ordered_fixes(
        e,
        lat=F.when(bad_lat, "n/a").otherwise((F.col("series_id") / 10).cast("string")),
        lon=F.col("value").cast("string"),
        alt=F.col("event_id").cast("string"),
        ts=F.when(bad_time, "--").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
    )
    return out.select(secs("ts").alias("ts_s"), r6("lat").alias("lat"), r6("lon").alias("lon"), r6("alt").alias("alt"))


@query(
    "k3_fold_table",
    f"WITH {X}, s AS (SELECT DISTINCT sample_id FROM x), f AS (SELECT sample_id, ((row_number() OVER (ORDER BY {sql_draw(chr(39) + '2' + chr(39), '1', 'sample_id')}, sample_id) - 1) % 4)::INT AS own FROM s)"
    " SELECT k AS fold, sample_id, CASE WHEN own = k THEN 'test' ELSE 'train' END AS split FROM f, (SELECT unnest(range(0, 4))::INT AS k)",
)
def _(spark, sf):
    return splits.fold_table(splits.kfold(samples(spark, sf), 4, seed=2), 4).select("fold", "sample_id", "split")


def _vote_sql(k):
    """Vote of the ``k`` nearest rows of the other fold."""
    return (
        f"WITH {X}, s AS (SELECT DISTINCT sample_id, (label < 5)::INT AS y FROM x), f AS (SELECT sample_id, y, (row_number() OVER (ORDER BY {sql_draw(chr(39) + '1' + chr(39), '1', 'sample_id')}, sample_id) - 1) % 2 AS fold FROM s),"
        " e AS (SELECT f.*, embedding::DOUBLE[64] AS v FROM f JOIN embeddings ON vec_id = sample_id), d AS (SELECT a.sample_id, b.y, count(*) OVER (PARTITION BY a.sample_id) AS n, row_number() OVER (PARTITION BY a.sample_id ORDER BY"
        f" array_distance(a.v, b.v), b.sample_id) AS rn FROM e a JOIN e b ON a.fold != b.fold) SELECT sample_id, (avg(y) > 0.5)::INT AS y_pred, {q6('avg(y)')} AS prob FROM d WHERE rn <= {k} GROUP BY 1"
    )


@query("m10_nearest_neighbours", _vote_sql("15"))
def _(spark, sf):
    out = models.nearest_neighbours(_folds(spark, sf), 15, 2, block_rows=200)
    return out.withColumn("prob", r6("prob"))


@query("m10_nearest_neighbours_root", _vote_sql("floor(sqrt(n))"))
def _(spark, sf):
    out = models.nearest_neighbours(_folds(spark, sf), None, 2)
    return out.withColumn("prob", r6("prob"))
