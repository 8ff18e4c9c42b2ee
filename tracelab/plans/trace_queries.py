"""Queries over traces: cleaning, grids, roll-ups, gaps and imputation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tracelab.operators import grid, impute, runlength
from tracelab.plans.bindings import HOURLY, S, hourly_grid, q6, qsecs, r6, secs, series, table
from tracelab.plans.registry import query
from tracelab.session import materialise

REC = (
    "rec AS (SELECT user_id AS series_id, ts, event_id, value, (event_id % 97)::INT AS signal_strength,"
    " (event_id % 13)::INT AS battery_voltage FROM events)"
)


def records(spark, sf):
    """Raw records with stand-in signal and battery readings."""
    return series(spark, sf).withColumns(
        {
            "signal_strength": (F.col("event_id") % 97).cast("int"),
            "battery_voltage": (F.col("event_id") % 13).cast("int"),
            "serial_ts": F.col("ts"),
        }
    )


# -- T1..T5 ------------------------------------------------------------------


@query("t1_regular_grid", f"WITH {HOURLY} SELECT series_id, {qsecs('ts')} AS ts_s, pos, {q6('value')} AS value FROM g")
def _(spark, sf):
    return hourly_grid(spark, sf).select("series_id", secs("ts").alias("ts_s"), "pos", r6("value").alias("value"))


COMMON = (
    "h AS (SELECT user_id AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS value FROM events GROUP BY 1, 2),\n"
    "e AS (SELECT date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) + INTERVAL 1 DAY AS hi FROM h),\n"
    "ids AS (SELECT DISTINCT series_id FROM h),\n"
    "gg AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts, lo FROM ids, e),\n"
    "g AS (SELECT gg.series_id, gg.ts, date_diff('hour', lo, gg.ts) AS pos, h.value FROM gg"
    " LEFT JOIN h ON h.series_id = gg.series_id AND h.ts = gg.ts)"
)


def common_hourly(spark, sf):
    return grid.common_grid(grid.bucket_sum(series(spark, sf), "1 hour"), "1 hour")


# every customer is an animal of the herd; most of them have no record
SILENT = COMMON.replace(
    "SELECT DISTINCT series_id FROM h)", "SELECT series_id FROM h UNION SELECT c_custkey AS series_id FROM customer)"
)


@query(
    "t2_common_herd_grid",
    f"WITH {SILENT} SELECT series_id, count(*) AS cells, count(value) AS seen, min({qsecs('ts')}) AS lo_s,"
    f" max({qsecs('ts')}) AS hi_s, {q6('sum(value)')} AS total, sum(pos)::BIGINT AS pos_sum FROM g GROUP BY 1",
)
def _(spark, sf):
    h = grid.bucket_sum(series(spark, sf), "1 hour")
    ids = h.select("series_id").union(table(spark, sf, "customer").select(F.col("c_custkey").alias("series_id")))
    return (
        grid.common_grid(h, "1 hour", ids=ids)
        .groupBy("series_id")
        .agg(
            F.count(F.lit(1)).alias("cells"),
            F.count("value").alias("seen"),
            F.min(secs("ts")).alias("lo_s"),
            F.max(secs("ts")).alias("hi_s"),
            r6(F.sum("value")).alias("total"),
            F.sum("pos").alias("pos_sum"),
        )
    )


@query(
    "t3_collision_backfill",
    "WITH r AS (SELECT user_id AS series_id, event_id, (epoch_us(ts) // 3600000000)::BIGINT AS bin,"
    " row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)"
    " SELECT series_id, event_id, bin, (min(bin + rn) OVER (PARTITION BY series_id ORDER BY rn) - rn)::BIGINT AS slot"
    " FROM r",
)
def _(spark, sf):
    out = grid.backfill_collisions(series(spark, sf), "1 hour", tie="event_id")
    return out.select("series_id", "event_id", "bin", "slot")


@query(
    "t4_simple_resample",
    f"WITH {REC}, h AS (SELECT series_id, date_trunc('hour', ts) AS ts, sum(value) AS value,"
    " min(signal_strength) AS signal_min, max(signal_strength) AS signal_max, avg(battery_voltage) AS battery,"
    " min(ts) AS first_ts FROM rec GROUP BY 1, date_trunc('hour', ts)),"
    " b AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY 1)"
    f" SELECT series_id, {qsecs('b.ts')} AS ts_s, {q6('value')} AS value, signal_min, signal_max,"
    f" {q6('battery')} AS battery, epoch_us(first_ts)::BIGINT AS first_us FROM b LEFT JOIN h USING (series_id, ts)",
)
def _(spark, sf):
    out = grid.simple_resample(records(spark, sf), "1 hour")
    return out.select(
        "series_id",
        secs("ts").alias("ts_s"),
        r6("value").alias("value"),
        "signal_min",
        "signal_max",
        r6("battery").alias("battery"),
        F.unix_micros("first_ts").alias("first_us"),
    )


@query(
    "t5_drop_duplicate_records",
    f"WITH {S} SELECT DISTINCT series_id, epoch_us(date_trunc('hour', ts))::BIGINT AS ts_us,"
    " floor(value)::BIGINT AS value FROM s",
)
def _(spark, sf):
    coarse = series(spark, sf).select(
        "series_id", F.date_trunc("hour", "ts").alias("ts"), F.floor("value").alias("value")
    )
    return grid.drop_duplicate_records(coarse).select("series_id", F.unix_micros("ts").alias("ts_us"), "value")


# -- roll-ups ----------------------------------------------------------------

_ROLL = (
    " sum(value) AS value, min(signal_strength) AS signal_min, max(signal_strength) AS signal_max,"
    " avg(battery_voltage) AS battery, min(ts) AS first_ts FROM rec GROUP BY 1, 2"
)
_BUCKETS = {
    "5 minutes": "time_bucket(INTERVAL 5 MINUTE, ts)",
    "10 minutes": "time_bucket(INTERVAL 10 MINUTE, ts)",
    "hour": "date_trunc('hour', ts)",
    "day": "date_trunc('day', ts)",
    "week": "date_trunc('week', ts)",
    "month": "date_trunc('month', ts)",
}
_ROLL_OUT = (
    f"SELECT series_id, {qsecs('bucket')} AS bucket_s, {q6('value')} AS value, signal_min, signal_max,"
    f" {q6('battery')} AS battery, epoch_us(first_ts)::BIGINT AS first_us"
)


def roll_out(df, *extra):
    return df.select(
        "series_id",
        secs("bucket").alias("bucket_s"),
        r6("value").alias("value"),
        "signal_min",
        "signal_max",
        r6("battery").alias("battery"),
        F.unix_micros("first_ts").alias("first_us"),
        *extra,
    )


@query(
    "d3_resample_to_resolution",
    f"WITH {REC}, x AS (SELECT series_id, {_BUCKETS['day']} AS bucket, {_ROLL}) {_ROLL_OUT} FROM x",
)
def _(spark, sf):
    return roll_out(grid.resample(records(spark, sf), "day"))


ROLL_ALL = " UNION ALL ".join(
    f"SELECT '{name}' AS resolution, * FROM (SELECT series_id, {b} AS bucket, {_ROLL})" for name, b in _BUCKETS.items()
)


@query("d3_all_resolutions", f"WITH {REC}, x AS ({ROLL_ALL}) {_ROLL_OUT}, resolution FROM x")
def _(spark, sf):
    return roll_out(grid.rollups(records(spark, sf)), "resolution")


def _from_first_sql(step):
    bucket = f"lo + ((epoch_us(ts) // 1000000 - lo) // {step}) * {step}"
    return (
        f"WITH {REC}, f AS (SELECT series_id, min(epoch_us(ts) // 1000000)::BIGINT AS lo FROM rec GROUP BY 1)"
        f" SELECT series_id, ({bucket})::BIGINT AS bucket_s, {q6('sum(value)')} AS value,"
        " max(signal_strength) AS signal_max, min(signal_strength) AS signal_min,"
        " min(battery_voltage) AS battery_min FROM rec JOIN f USING (series_id) GROUP BY 1, 2"
    )


def _filled_sql(step):
    base = _from_first_sql(step)
    return (
        f"WITH o AS ({base}), e AS (SELECT series_id, min(bucket_s) AS lo, max(bucket_s) AS hi FROM o GROUP BY 1),"
        f" g AS (SELECT series_id, unnest(generate_series(lo, hi, {step}))::BIGINT AS bucket_s FROM e)"
        " SELECT series_id, bucket_s, value, signal_max, signal_min, battery_min FROM g LEFT JOIN o USING (series_id, bucket_s)"
    )


for _name, _step in (("10_minutes", "10 minutes"), ("hour", "1 hours"), ("day", "1 days"), ("week", "7 days"), ("month", "30 days")):

    @query(f"d4_every_step_{_name}", _filled_sql(grid.seconds(_step)))
    def _(spark, sf, step=_step):
        return grid.resample_from_first_filled(records(spark, sf), step).withColumn("value", r6("value"))


for _name, _step in (
    ("1_minute", "1 minutes"), ("5_minutes", "5 minutes"), ("10_minutes", "10 minutes"), ("hour", "1 hours"), ("day", "1 days"), ("week", "7 days"), ("month", "30 days"),
):

    @query(f"d4_older_rollup_{_name}", _from_first_sql(grid.seconds(_step)))
    def _(spark, sf, step=_step):
        return grid.resample_from_first(records(spark, sf), step).withColumn("value", r6("value"))


@query(
    "d5_null_preserving_sum",
    f"WITH {COMMON} SELECT series_id, {qsecs('date_trunc($$day$$, ts)')} AS day_s, {q6('sum(value)')} AS value"
    " FROM g GROUP BY 1, 2",
)
def _(spark, sf):
    out = grid.bucket_sum(common_hourly(spark, sf), "1 day")
    return out.select("series_id", secs("ts").alias("day_s"), r6("value").alias("value"))


@query(
    "d6_null_preserving_median",
    f"WITH {COMMON} SELECT series_id, {qsecs('date_trunc($$day$$, ts)')} AS bucket_s, count(*) AS n,"
    f" {q6('median(value)')} AS value FROM g GROUP BY 1, 2",
)
def _(spark, sf):
    out = grid.resample_with(common_hourly(spark, sf), "day", {"value": "median"})
    return out.select("series_id", secs("bucket").alias("bucket_s"), "n", r6("value").alias("value"))


@query(
    "d26_heatmap_resample",
    f"WITH {REC} SELECT series_id, {qsecs('date_trunc($$day$$, ts)')} AS bucket_s, count(*) AS n,"
    f" {q6('sum(value)')} AS value, sum(event_id % 2)::BIGINT AS imputed, sum(event_id % 31)::BIGINT AS xmin,"
    f" {q6('median(signal_strength)')} AS signal_strength, {q6('median(battery_voltage)')} AS battery_voltage"
    " FROM rec GROUP BY 1, 2",
)
def _(spark, sf):
    rec = records(spark, sf).withColumns({"imputed": F.col("event_id") % 2, "xmin": F.col("event_id") % 31})
    how = {
        "value": "sum",
        "imputed": "sum",
        "xmin": "sum",
        "signal_strength": "median",
        "battery_voltage": "median",
    }
    out = grid.resample_with(rec, "day", how)
    return out.select(
        "series_id",
        secs("bucket").alias("bucket_s"),
        "n",
        r6("value").alias("value"),
        "imputed",
        "xmin",
        r6("signal_strength").alias("signal_strength"),
        r6("battery_voltage").alias("battery_voltage"),
    )


@query(
    "k1_aggregate_per_column",
    f"WITH {REC} SELECT series_id, {qsecs('date_trunc($$hour$$, ts)')} AS bucket_s, count(*) AS n,"
    f" {q6('sum(value)')} AS value, min(signal_strength) AS signal_strength,"
    " arg_min(battery_voltage, ts) AS battery_voltage, max(event_id) AS event_id FROM rec GROUP BY 1, 2",
)
def _(spark, sf):
    how = {"value": "sum", "signal_strength": "min", "battery_voltage": "first", "event_id": "max"}
    out = grid.resample_with(records(spark, sf), "hour", how)
    return out.withColumns({"value": r6("value"), "bucket_s": secs("bucket")}).drop("bucket")


# -- gaps --------------------------------------------------------------------

RUNS = (
    "m AS (SELECT *, {kind} AS kind FROM g),\n"
    "c AS (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY series_id ORDER BY pos))::INT AS chg FROM m),\n"
    "i AS (SELECT *, sum(chg) OVER (PARTITION BY series_id ORDER BY pos) AS island FROM c),\n"
    "runs AS (SELECT *, min(pos) OVER (PARTITION BY series_id, island) AS run_start,"
    " max(pos) OVER (PARTITION BY series_id, island) AS run_end,"
    " count(*) OVER (PARTITION BY series_id, island) AS run_len,"
    " row_number() OVER (PARTITION BY series_id, island ORDER BY pos) AS run_pos FROM i)"
)
NULL_KIND = "CASE WHEN value IS NULL THEN 'null' ELSE 'seen' END"
ZERO_KIND = "CASE WHEN value = 0 THEN 'zero' ELSE 'other' END"
NULL_RUNS = RUNS.format(kind=NULL_KIND)
ZERO_RUNS = RUNS.format(kind=ZERO_KIND)


@query(
    "e5_null_runs",
    f"WITH {HOURLY}, {NULL_RUNS} SELECT series_id, pos, kind, run_start, run_end, run_len, run_pos FROM runs",
)
def _(spark, sf):
    return runlength.cells_of_runs(runlength.null_runs(sparse_hourly(spark, sf)))


# counts with zeros and nulls: hours of no record are null when their number is odd
G0 = HOURLY.replace("\ng AS (", "\ng0 AS (")
ZEROS = G0 + (
    ",\n g AS (SELECT series_id, ts, pos, CASE WHEN value IS NULL AND pos % 37 = 0 THEN NULL"
    " WHEN value IS NULL OR value < 20 THEN 0.0 ELSE value END AS value FROM g0)"
)


def zero_grid(spark, sf):
    v = F.col("value")
    return hourly_grid(spark, sf).withColumn(
        "value",
        F.when(v.isNull() & (F.col("pos") % 37 == 0), F.lit(None))
        .when(v.isNull() | (v < 20), F.lit(0.0))
        .otherwise(v),
    )


def hourly_sums(spark, sf):
    return grid.bucket_sum(series(spark, sf), "1 hour")


def sparse_hourly(spark, sf):
    """The hourly trace by its records alone."""
    return runlength.own_grid(hourly_sums(spark, sf), "1 hour")


def sparse_common(spark, sf):
    """The hourly trace on the herd's grid by its records alone."""
    return runlength.herd_grid(hourly_sums(spark, sf), "1 hour")


def sparse_zeros(spark, sf):
    """The trace of ``zero_grid`` by the cells that are not zero: large sums, and every 37th hour if it has no record."""
    trace = sparse_hourly(spark, sf)
    large = trace.cells.where("value >= 20")
    every = trace.spans.select("series_id", F.explode(F.sequence(F.col("first"), F.col("last"), F.lit(37).cast("long"))).alias("pos"))
    blank = every.join(trace.cells.where("value IS NOT NULL"), ["series_id", "pos"], "left_anti").select("series_id", "pos", F.lit(None).cast("double").alias("value"))
    return runlength.SparseTrace(materialise(large.unionByName(blank), "cells-not-zero"), trace.spans, 0.0)


@query("e5_zero_runs", f"WITH {ZEROS}, {ZERO_RUNS} SELECT series_id, pos, kind, run_len, run_pos FROM runs")
def _(spark, sf):
    return runlength.cells_of_runs(runlength.zero_runs(sparse_zeros(spark, sf))).select("series_id", "pos", "kind", "run_len", "run_pos")


@query(
    "e6_gap_histogram",
    f"WITH {ZEROS}, "
    + NULL_RUNS.replace("m AS", "nm AS").replace("FROM m)", "FROM nm)").replace("c AS (", "nc AS (")
    .replace("FROM c)", "FROM nc)").replace("i AS (", "ni AS (").replace("FROM i)", "FROM ni)")
    .replace("runs AS", "nruns AS")
    + f", {ZERO_RUNS} SELECT kind, run_len, count(*) AS n FROM nruns WHERE kind = 'null' AND run_pos = 1 GROUP BY 1, 2"
    " UNION ALL SELECT kind, run_len, count(*) AS n FROM runs WHERE kind = 'zero' AND run_pos = 1 GROUP BY 1, 2",
)
def _(spark, sf):
    return runlength.gap_histogram(sparse_zeros(spark, sf))


AROUND = (
    "a AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN pos END) OVER (PARTITION BY series_id ORDER BY pos) AS lp,"
    " min(CASE WHEN value IS NOT NULL THEN pos END) OVER (PARTITION BY series_id ORDER BY pos"
    " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np,"
    " min(pos) OVER (PARTITION BY series_id) AS p0, max(pos) OVER (PARTITION BY series_id) AS p1 FROM g),\n"
    "ar AS (SELECT a.*, l.value AS lv, n.value AS nv,"
    " coalesce(np, p1 + 1) - coalesce(lp, p0 - 1) - 1 AS gap FROM a"
    " LEFT JOIN g l ON l.series_id = a.series_id AND l.pos = a.lp"
    " LEFT JOIN g n ON n.series_id = a.series_id AND n.pos = a.np)"
)
LINE = "lv + (nv - lv) * (pos - lp) / (np - lp)"


def _fill_sql(expr, base=HOURLY):
    return (
        f"WITH {base}, {AROUND} SELECT series_id, pos,"
        f" {q6(f'CASE WHEN value IS NULL THEN {expr} ELSE value END')} AS value FROM ar"
    )


def _fill(df):
    return df.select("series_id", "pos", r6("value").alias("value"))


LINE_HELD = f"coalesce({LINE}, lv, nv)"


@query("t6_bounded_interpolation", _fill_sql(f"CASE WHEN gap <= 6 THEN {LINE_HELD} END", COMMON))
def _(spark, sf):
    return _fill(runlength.bounded_interpolation(runlength.herd_grid(hourly_sums(spark, sf), "1 hour"), 6))


@query("t6_bounded_interpolation_exclusive", _fill_sql(f"CASE WHEN gap < 6 THEN {LINE_HELD} END"))
def _(spark, sf):
    return _fill(runlength.bounded_interpolation(sparse_hourly(spark, sf), 6, inclusive=False))


@query("t7_constant_fill", _fill_sql("CASE WHEN gap <= 6 THEN -1.0 END"))
def _(spark, sf):
    return _fill(runlength.constant_fill(sparse_hourly(spark, sf), 6))


@query(
    "t8_zero_runs_to_null_chunked",
    f"WITH {ZEROS}, {ZERO_RUNS} SELECT series_id, pos, CASE WHEN kind = 'zero' AND run_pos <="
    " ((run_len - (run_end = max(pos) OVER (PARTITION BY series_id))::INT) // 5) * 5 THEN NULL"
    f" ELSE {q6('value')} END AS value FROM runs",
)
def _(spark, sf):
    return _fill(runlength.zeros_to_null(sparse_zeros(spark, sf), 5))


@query(
    "t8_zero_runs_to_null_whole",
    f"WITH {ZEROS}, {ZERO_RUNS} SELECT series_id, pos, CASE WHEN kind = 'zero' AND run_len >= 5 THEN NULL"
    f" ELSE {q6('value')} END AS value FROM runs",
)
def _(spark, sf):
    return _fill(runlength.zeros_to_null(sparse_zeros(spark, sf), 5, mode="run"))


@query("t9_linear_fill", _fill_sql(LINE_HELD))
def _(spark, sf):
    return _fill(runlength.linear_fill(sparse_hourly(spark, sf)))


@query("t10_nearest_fill", _fill_sql("CASE WHEN pos - lp <= np - pos THEN lv ELSE coalesce(nv, lv) END", COMMON))
def _(spark, sf):
    return _fill(runlength.nearest_fill(sparse_common(spark, sf)))


@query("t11_hold_leading", _fill_sql("CASE WHEN lp IS NULL THEN nv END", COMMON))
def _(spark, sf):
    return _fill(runlength.hold_leading(sparse_common(spark, sf)))


@query("t12_linear_then_zero", _fill_sql(f"coalesce({LINE}, lv, 0.0)", COMMON))
def _(spark, sf):
    return _fill(runlength.linear_then_zero(sparse_common(spark, sf)))


@query(
    "e9_elapsed_since_seen",
    f"WITH {COMMON} SELECT series_id, pos, pos - max(CASE WHEN value IS NOT NULL OR pos = 0 THEN pos END)"
    " OVER (PARTITION BY series_id ORDER BY pos) + 1 AS elapsed FROM g",
)
def _(spark, sf):
    return impute.elapsed_since_seen(common_hourly(spark, sf)).select("series_id", "pos", "elapsed")


@query(
    "e10_derivative",
    f"WITH {ZEROS} SELECT series_id, pos, {q6('(value - lag(value) OVER (PARTITION BY series_id ORDER BY pos)) / 60.0')}"
    " AS slope FROM g",
)
def _(spark, sf):
    return impute.derivative(zero_grid(spark, sf), 60.0).select("series_id", "pos", r6("slope").alias("slope"))


def _moving_sql(shift):
    return (
        f"WITH {ZEROS}, w AS (SELECT series_id, pos, count(value) OVER f AS c, avg(value) OVER f AS mean FROM g"
        " WINDOW f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"
        f" SELECT series_id, pos - {shift} AS pos, {q6('mean')} AS mean FROM w WHERE c = 24"
    )


@query("e13_moving_average", _moving_sql(0))
def _(spark, sf):
    return impute.moving_average(zero_grid(spark, sf), 24).withColumn("mean", r6("mean"))


@query("e13_moving_average_centred", _moving_sql(11))
def _(spark, sf):
    return impute.moving_average(zero_grid(spark, sf), 24, centred=True).withColumn("mean", r6("mean"))


# -- masks and errors --------------------------------------------------------


def sql_draw(*parts):
    """The SQL text of the same md5 draw."""
    text = ", ".join(parts)
    return f"(('0x' || left(md5(concat_ws(':', {text})), 8))::BIGINT)"


MASK_DRAW = sql_draw("'7'", "series_id", "pos")
MASKED = (
    f"mk AS (SELECT *, (coalesce(value != 0, false) AND {MASK_DRAW} < {int(0.2 * 2**32)})::INT AS masked FROM g0),\n"
    "g AS (SELECT series_id, ts, pos, masked, value AS truth, CASE WHEN masked = 0 THEN value END AS value FROM mk)"
)


def masked_grid(spark, sf):
    return impute.blank_masked(impute.missing_mask(hourly_grid(spark, sf), 0.2, 7))


@query("t13_missing_mask", f"WITH {G0}, {MASKED} SELECT series_id, pos, masked, {q6('value')} AS value FROM g")
def _(spark, sf):
    return masked_grid(spark, sf).select("series_id", "pos", "masked", r6("value").alias("value"))


IMPUTED = (
    f"{G0}, {MASKED}, {AROUND}, im AS (SELECT series_id, pos, ts, masked, truth,"
    f" CASE WHEN value IS NULL THEN {LINE_HELD} ELSE value END AS value FROM ar)"
)


def imputed_grid(spark, sf):
    """The masked grid, filled; only recorded cells can be masked."""
    trace = sparse_hourly(spark, sf)
    masked = impute.blank_masked(impute.missing_mask(trace.cells, 0.2, 7))
    return runlength.linear_fill(replace(trace, cells=masked), {"masked": 0, "truth": None})


_ERR = (
    f"count(truth - value) AS n, {q6('avg(abs(truth - value))')} AS mae, {q6('avg((truth - value) ** 2)')} AS mse,"
    f" {q6('sqrt(avg((truth - value) ** 2))')} AS rmse FROM im WHERE masked = 1"
)


def _errors(df):
    return df.withColumns({c: r6(c) for c in ("mae", "mse", "rmse")})


@query("t15_imputation_error", f"WITH {IMPUTED} SELECT {_ERR}")
def _(spark, sf):
    return _errors(impute.imputation_error(imputed_grid(spark, sf), []))


@query("t15_imputation_error_per_series", f"WITH {IMPUTED} SELECT series_id, {_ERR} GROUP BY 1")
def _(spark, sf):
    return _errors(impute.imputation_error(imputed_grid(spark, sf), ["series_id"]))


@query(
    "t15_weighted_error_per_sample",
    f"WITH {IMPUTED} SELECT series_id, pos // 24 AS sample, sum(masked)::DOUBLE AS weight, {q6('sqrt(sum(masked * (coalesce(truth, 0) - coalesce(value, 0)) ** 2) / nullif(sum(masked), 0))')} AS rmse"
    " FROM im GROUP BY 1, 2",
)
def _(spark, sf):
    cells = imputed_grid(spark, sf).withColumns({"sample": F.floor(F.col("pos") / 24), "weight": F.col("masked").cast("double")})
    out = impute.weighted_sample_error(cells, ["series_id", "sample"])
    return out.select("series_id", "sample", "weight", r6("rmse").alias("rmse"))


CEILINGS = [i / 10 for i in range(10)]


@query(
    "t15_error_by_ceiling",
    f"WITH {IMPUTED}, c AS (SELECT unnest({CEILINGS}::DOUBLE[]) AS ceiling), held AS (SELECT * FROM im WHERE masked = 1)"
    f" SELECT ceiling, count(*) AS n, {q6('sqrt(avg((truth - value) ** 2))')} AS rmse FROM held JOIN c"
    " ON truth >= ceiling * (SELECT max(truth) FROM held) GROUP BY 1",
)
def _(spark, sf):
    return impute.error_by_ceiling(imputed_grid(spark, sf), CEILINGS).withColumn("rmse", r6("rmse"))


@query(
    "t16_bootstrap_error",
    f"WITH {IMPUTED}, per AS (SELECT series_id, sum((truth - value) ** 2) AS sse, count(*) AS n FROM im"
    f" WHERE masked = 1 GROUP BY 1), num AS (SELECT *, row_number() OVER (ORDER BY {sql_draw(chr(39) + '11' + chr(39), 'series_id')},"
    " series_id) AS rank FROM per), reps AS (SELECT unnest(range(1, 101)) AS replicate),"
    f" d AS (SELECT replicate, {sql_draw(chr(39) + '11' + chr(39), 'replicate', 'rank')} % (SELECT count(*) FROM per) + 1"
    " AS pick FROM num, reps), e AS (SELECT replicate, sqrt(sum(sse) / sum(n)) AS rmse FROM d JOIN num"
    " ON num.rank = d.pick GROUP BY 1)"
    f" SELECT count(*) AS n, {q6('quantile_cont(rmse, 0.025)')} AS low, {q6('quantile_cont(rmse, 0.5)')} AS median,"
    f" {q6('quantile_cont(rmse, 0.975)')} AS high FROM e",
)
def _(spark, sf):
    out = impute.bootstrap_error(imputed_grid(spark, sf), 100, 11)
    return out.withColumns({c: r6(c) for c in ("low", "median", "high")})


# -- positions and blocks ----------------------------------------------------


@query(
    "t17_screen_width",
    f"WITH {HOURLY}, n AS (SELECT series_id, count(*) AS n FROM g GROUP BY 1),"
    " x AS (SELECT g.*, (pos * 100) // n AS bin FROM g JOIN n USING (series_id))"
    f" SELECT series_id, bin, {q6('sum(value)')} AS value, {qsecs('max(ts)')} AS last_s FROM x GROUP BY 1, 2",
)
def _(spark, sf):
    out = grid.shrink_to_width(hourly_grid(spark, sf), 100)
    return out.select("series_id", "bin", r6("value").alias("value"), secs("last_ts").alias("last_s"))


@query(
    "t20_crop_to_weeks",
    f"WITH {HOURLY}, n AS (SELECT series_id, count(*) AS n FROM g GROUP BY 1)"
    f" SELECT series_id, pos, {q6('value')} AS value FROM g JOIN n USING (series_id) WHERE pos < (n // 168) * 168",
)
def _(spark, sf):
    return _fill(grid.crop_to_blocks(hourly_grid(spark, sf), 168))


@query(
    "t21_block_reshape",
    f"WITH {HOURLY} SELECT series_id, pos // 24 AS block, count(*) AS cells, string_agg(coalesce(round(value)::BIGINT::VARCHAR,"
    " '_'), ',' ORDER BY pos) AS cells_text FROM g GROUP BY 1, 2",
)
def _(spark, sf):
    out = grid.to_blocks(hourly_grid(spark, sf), 24)
    text = F.transform("values", lambda v: F.coalesce(F.round(v).cast("long").cast("string"), F.lit("_")))
    return out.select(
        "series_id", "block", F.size("values").cast("long").alias("cells"), F.array_join(text, ",").alias("cells_text")
    )


@query("t21_block_reshape_inverse", f"WITH {HOURLY} SELECT series_id, pos, {q6('value')} AS value FROM g")
def _(spark, sf):
    return _fill(grid.from_blocks(grid.to_blocks(hourly_grid(spark, sf), 24), 24))


@query(
    "e15_padded_blocks",
    f"WITH {HOURLY}, n AS (SELECT series_id, max(pos) + 1 AS n FROM g GROUP BY 1),"
    " p AS (SELECT series_id, n, unnest(generate_series(0, ((n + 71) // 72) * 72 - 1)) AS pos FROM n)"
    f" SELECT p.series_id, p.pos, {q6('g.value')} AS value FROM p JOIN g ON g.series_id = p.series_id"
    " AND g.pos = least(p.pos, p.n - 1)",
)
def _(spark, sf):
    return _fill(grid.from_blocks(grid.to_blocks(hourly_grid(spark, sf), 72, pad=True), 72))
