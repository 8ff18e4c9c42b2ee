"""Queries over labels, predictions and experiment reports: counts, rankings, splits, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.functions import scalar
from tracelab.operators import certificates, evaluate, filters, grid, herd, models, sets, splits, stats
from tracelab.operators.labels import light_phase
from tracelab.plans.bindings import (
    HOURLY, P, R, S, V, VE, X, hourly_grid, predictions, q6, qsecs, r6, reports, samples, secs, series, table, visits,
    visits_on_series, weather,
)
from tracelab.plans.registry import query
from tracelab.plans.trace_queries import COMMON, REC, common_hourly, records, sql_draw
from tracelab.plans.visit_queries import LAB, PHASE, SUN, day_text, labelled, qday
from tracelab.session import materialise

# -- record filters ----------------------------------------------------------


@query("b1_plausible_range", f"WITH {S} SELECT event_id, {q6('value')} AS value FROM s WHERE value BETWEEN 0 AND 200")
def _(spark, sf):
    return filters.plausible(series(spark, sf), 200).select("event_id", r6("value").alias("value"))


@query(
    "b1_rejected_counts",
    "SELECT count(*) FILTER (value - 1 < 0) AS negative, count(*) FILTER (value - 1 > 200) AS above, count(*) AS total FROM events",
)
def _(spark, sf):
    return filters.rejected_counts(series(spark, sf).withColumn("value", F.col("value") - 1), 200)


@query("b2_station_and_year", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1997")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return filters.only_station(o, F.col("o_orderstatus") == "F", 1997, "o_orderdate").select("o_orderkey")


@query(
    "b3_time_slice",
    f"WITH {S} SELECT event_id FROM s WHERE ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'",
)
def _(spark, sf):
    return filters.between_times(series(spark, sf), "2024-01-08 00:00:00", "2024-01-20 12:00:00").select("event_id")


@query(
    "b5_keep_and_ignore",
    "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)"
    " AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    keep = table(spark, sf, "nation").filter(F.col("n_regionkey") < 3).select(F.col("n_nationkey").alias("c_nationkey"))
    ignore = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return filters.ignore_ids(filters.keep_ids(c, keep, "c_nationkey"), ignore, "c_custkey").select("c_custkey")


@query(
    "b17_good_traces",
    f"WITH {HOURLY}, z AS (SELECT series_id, pos, coalesce(floor(value / 50), CASE WHEN pos % 9 = 0 THEN 0 END) AS value FROM g),"
    " k AS (SELECT series_id FROM z GROUP BY 1 HAVING count(value) >= 105 AND count(*) FILTER (value = 0) >= 105)"
    " SELECT series_id, count(*) AS cells FROM z WHERE series_id IN (SELECT series_id FROM k) GROUP BY 1",
)
def _(spark, sf):
    v = F.coalesce(F.floor(F.col("value") / 50), F.when(F.col("pos") % 9 == 0, F.lit(0)))
    z = hourly_grid(spark, sf).withColumn("value", v)
    return filters.good_traces(z, 105).groupBy("series_id").agg(F.count(F.lit(1)).alias("cells"))


@query(
    "b18_good_windows",
    f"WITH {HOURLY}, w AS (SELECT series_id, pos // 24 AS \"window\", avg((value IS NULL)::INT::DOUBLE) AS r, sum(value) AS t,"
    " count(*) FILTER (value > 0) AS positive, count(*) AS cells FROM g GROUP BY 1, 2)"
    f" SELECT series_id, \"window\", {q6('r')} AS null_ratio, {q6('t')} AS total, positive, cells FROM w WHERE r <= 0.9 AND coalesce(t, 0) >= 50.001",
)
def _(spark, sf):
    out = filters.good_windows(hourly_grid(spark, sf), 24, 0.9, 50.001).drop("zeros")
    return out.withColumns({"null_ratio": r6("null_ratio"), "total": r6("total")})


@query(
    "b18_active_windows",
    f"WITH {HOURLY}, w AS (SELECT series_id, pos // 168 AS \"window\", count(*) FILTER (value > 0) AS positive, count(*) FILTER (value = 0) AS zeros, count(*) AS cells FROM g GROUP BY 1, 2)"
    " SELECT series_id, \"window\", positive, zeros, cells FROM w WHERE zeros < cells AND positive > 2",
)
def _(spark, sf):
    out = filters.active_windows(hourly_grid(spark, sf), 168, 2)
    return out.select("series_id", "window", "positive", "zeros", "cells")


_DQ = f"WITH {COMMON}, d AS (SELECT series_id, ts::DATE AS day, count(*) AS cells, count(*) - count(value) AS nulls FROM g GROUP BY 1, 2) SELECT series_id, {qday('day')} AS day, cells, nulls FROM d"


@query("b19_days_by_nulls", f"{_DQ} WHERE cells = 24 AND nulls >= 20")
def _(spark, sf):
    return filters.days_by_nulls(common_hourly(spark, sf), 24, 20).withColumn("day", day_text("day"))


@query("b19_complete_days", f"WITH {HOURLY}, q AS (SELECT ts, count(value) AS seen FROM g GROUP BY 1), d AS (SELECT 0 AS series_id, ts::DATE AS day, count(*) AS cells, count(*) FILTER (seen = 0) AS nulls FROM q GROUP BY 1, 2) SELECT series_id, {qday('day')} AS day, cells, nulls FROM d WHERE cells = 24 AND nulls = 0")
def _(spark, sf):
    seen = hourly_grid(spark, sf).groupBy("ts").agg(F.count("value").alias("seen"))
    herd_trace = seen.select(F.lit(0).alias("series_id"), "ts", F.when(F.col("seen") > 0, F.col("seen")).alias("value"))
    return filters.complete_days(herd_trace, 24).withColumn("day", day_text("day"))


# -- herd --------------------------------------------------------------------


@query(
    "d1_herd_mean_and_median",
    f"WITH {COMMON} SELECT {qsecs('ts')} AS ts_s, {q6('avg(value)')} AS mean, {q6('median(value)')} AS median, count(value) AS animals FROM g GROUP BY 1",
)
def herd_mean_and_median(spark, sf):
    out = herd.herd_series(common_hourly(spark, sf))
    return out.select(secs("ts").alias("ts_s"), r6("mean").alias("mean"), r6("median").alias("median"), "animals")


@query(
    "d1_daily_herd_curve",
    "WITH r AS (SELECT DISTINCT user_id, ts, value FROM events WHERE value BETWEEN 0 AND 480), d AS (SELECT user_id, date_trunc('day', ts) AS ts,"
    f" sum(value) AS value FROM r GROUP BY 1, 2) SELECT {qsecs('ts')} AS ts_s, {q6('avg(value)')} AS mean, {q6('median(value)')} AS median, count(*) AS animals FROM d GROUP BY 1",
)
def daily_herd_curve(spark, sf):
    clean = grid.drop_duplicate_records(filters.plausible(series(spark, sf)))
    out = herd.herd_series(grid.bucket_sum(clean, "1 day"))
    return out.select(secs("ts").alias("ts_s"), r6("mean").alias("mean"), r6("median").alias("median"), "animals")


@query(
    "d2_herd_older_rule",
    f"WITH {REC}, h AS (SELECT series_id, date_trunc('hour', ts) AS ts, sum(value - 20) AS value, avg(signal_strength) AS s, avg(battery_voltage) AS b"
    f" FROM rec GROUP BY 1, date_trunc('hour', ts)) SELECT {qsecs('ts')} AS ts_s, {q6('avg(CASE WHEN value > 0 THEN value END)')} AS mean,"
    f" {q6('median(coalesce(value, 0))')} AS median, {q6('avg(s)')} AS signal_strength, {q6('avg(b)')} AS battery_voltage FROM h GROUP BY ts",
)
def _(spark, sf):
    h = records(spark, sf).groupBy("series_id", F.date_trunc("hour", "ts").alias("ts")).agg(
        F.sum(F.col("value") - 20).alias("value"),
        F.avg("signal_strength").alias("signal_strength"),
        F.avg("battery_voltage").alias("battery_voltage"),
    )
    out = herd.herd_series_positive(h)
    return out.select(secs("ts").alias("ts_s"), *[r6(c).alias(c) for c in ("mean", "median", "signal_strength", "battery_voltage")])


@query(
    "d21_herd_rollup",
    f"WITH {VE} SELECT {qsecs('date_trunc($$day$$, visit_ts)')} AS bucket_s, {q6('avg(score)')} AS score, {q6('avg((score > 2)::INT)')} AS unhealthy FROM ve GROUP BY 1",
)
def _(spark, sf):
    v = visits_on_series(spark, sf).withColumn("unhealthy", (F.col("score") > 2).cast("int"))
    out = herd.herd_rollup(v, F.date_trunc("day", "visit_ts"), ["score", "unhealthy"])
    return out.select(secs("bucket").alias("bucket_s"), r6("score").alias("score"), r6("unhealthy").alias("unhealthy"))


# -- counts ------------------------------------------------------------------


@query(
    "d7_class_counts",
    f"WITH {V}, {LAB}, k AS (SELECT label, visit_id % 7 != 0 AS valid FROM lab WHERE label IS NOT NULL) SELECT coalesce(label, 'total') AS label,"
    " count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS not_valid, count(*) AS total FROM k GROUP BY ROLLUP (label)",
)
def _(spark, sf):
    k = labelled(spark, sf).filter(F.col("label").isNotNull()).withColumn("valid", F.col("visit_id") % 7 != 0)
    return stats.class_counts(k)


@query(
    "d8_label_pivot",
    f"WITH {V}, {LAB} SELECT series_id, " + ", ".join(f"count(*) FILTER (label = '{a}To{b}') AS \"{a}To{b}\"" for a in range(1, 6) for b in range(1, 6)) + " FROM lab GROUP BY 1",
)
def _(spark, sf):
    return stats.label_pivot(labelled(spark, sf), [f"{a}To{b}" for a in range(1, 6) for b in range(1, 6)])


@query(
    "d9_transition_matrix",
    f"WITH {V}, {LAB}, d AS (SELECT unnest(range(1, 6))::INT AS k) SELECT a.k AS prev1, b.k AS score, count(visit_id) AS n FROM d a CROSS JOIN d b"
    " LEFT JOIN lab ON prev1 = a.k AND score = b.k GROUP BY 1, 2",
)
def _(spark, sf):
    return stats.transition_matrix(labelled(spark, sf), "prev1", "score")


@query(
    "d10_validity_per_individual",
    f"WITH {V} SELECT series_id, count(*) FILTER (score < 4) AS valid, count(*) FILTER (score >= 4) AS invalid, count(*) AS total FROM v GROUP BY 1",
)
def _(spark, sf):
    return stats.validity_per_individual(visits(spark, sf).withColumn("valid", F.col("score") < 4))


_ENT = "n AS (SELECT series_id, v, count(*) AS c FROM k GROUP BY 1, 2), t AS (SELECT *, c / sum(c) OVER (PARTITION BY series_id) AS p FROM n)"


@query(
    "d11_value_entropy",
    f"WITH k AS (SELECT user_id AS series_id, floor(value / 10) AS v FROM events), {_ENT} SELECT series_id, {q6('-sum(p * ln(p))')} AS entropy FROM t GROUP BY 1",
)
def _(spark, sf):
    k = series(spark, sf).withColumn("v", F.floor(F.col("value") / 10))
    return stats.entropy(k, ["series_id"], "v").withColumn("entropy", r6("entropy"))


@query(
    "d11_weight_entropy",
    "WITH k AS (SELECT user_id AS series_id, value / sum(value) OVER (PARTITION BY user_id) AS p FROM events WHERE value > 0)"
    f" SELECT series_id, {q6('-sum(p * ln(p))')} AS entropy FROM k GROUP BY 1",
)
def _(spark, sf):
    return stats.weight_entropy(series(spark, sf), ["series_id"], "value").withColumn("entropy", r6("entropy"))


@query(
    "d11_histogram_entropy",
    "WITH e AS (SELECT user_id AS series_id, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id)),"
    f" k AS (SELECT series_id, least(floor((value - lo) / (hi - lo) * 10), 9) AS v FROM e), {_ENT} SELECT series_id, {q6('-sum(p * ln(p))')} AS entropy FROM t GROUP BY 1",
)
def _(spark, sf):
    return stats.histogram_entropy(series(spark, sf), ["series_id"], "value").withColumn("entropy", r6("entropy"))


@query(
    "d12_rounded_histogram",
    f"WITH {S} SELECT kind, {q6('round_even(value / 5.0::DOUBLE, 0) * 5')} AS bin, count(*) AS n FROM s GROUP BY 1, 2",
)
def _(spark, sf):
    return stats.rounded_histogram(series(spark, sf), ["kind"], "value", 5).withColumn("bin", r6("bin"))


@query(
    "d12_density",
    f"WITH {S}, d AS (SELECT kind, value / 100 AS v FROM s WHERE value / 100 BETWEEN 0 AND 1), b AS (SELECT kind, least(floor(v * 50), 49)::BIGINT AS bin,"
    f" count(*) AS n FROM d GROUP BY 1, 2) SELECT kind, bin, n, {q6('n * 50 / (sum(n) OVER (PARTITION BY kind))')} AS density FROM b",
)
def _(spark, sf):
    d = series(spark, sf).withColumn("v", F.col("value") / 100)
    return stats.density(d, ["kind"], "v").withColumn("density", r6("density"))


@query(
    "d15_samples_per_individual",
    f"WITH {V}, n AS (SELECT series_id, visit_id FROM v) SELECT series_id, 0::BIGINT AS part, string_agg(visit_id::VARCHAR, ',' ORDER BY visit_id) AS items FROM n GROUP BY 1",
)
def _(spark, sf):
    out = stats.listed(visits(spark, sf), "series_id", "visit_id")
    return out.withColumn("items", F.array_join("items", ","))


@query(
    "d16_dataset_span",
    f"WITH {V}, n AS (SELECT *, row_number() OVER (ORDER BY visit_id) - 1 AS nr, count(*) OVER () AS c FROM v) SELECT count(DISTINCT series_id) AS individuals,"
    f" count(*) AS n, {qday('min(visit_date)')} AS min_date, {qday('max(visit_date)')} AS max_date, {qday('arg_min(visit_date, visit_id)')} AS first_date,"
    f" {qday('arg_max(visit_date, visit_id)')} AS last_date, {qday('max(CASE WHEN nr = c // 2 THEN visit_date END)')} AS middle_date FROM n",
)
def _(spark, sf):
    out = stats.dataset_span(visits(spark, sf), key="series_id", date="visit_date", order="visit_id")
    dates = ("min_date", "max_date", "first_date", "last_date", "middle_date")
    return out.select("individuals", "n", *[day_text(d).alias(d) for d in dates])


@query(
    "d17_daily_weather",
    "WITH wx AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS temp_c FROM events GROUP BY 1)"
    f" SELECT {qday('hour')} AS day, count(*) AS hours, {q6('avg(temp_c)')} AS temp_c FROM wx GROUP BY 1",
)
def _(spark, sf):
    out = stats.daily_weather(weather(spark, sf), ["temp_c"])
    return out.select(day_text("day").alias("day"), "hours", r6("temp_c").alias("temp_c"))


@query(
    "d18_value_counts",
    f"WITH {V}, c AS (SELECT series_id, score, count(*) AS n FROM v GROUP BY 1, 2) SELECT series_id, string_agg(score || ':' || n, ',' ORDER BY score) AS counts FROM c GROUP BY 1",
)
def _(spark, sf):
    out = stats.value_counts_map(visits(spark, sf), "series_id", "score")
    pairs = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return out.select("series_id", F.array_join(pairs, ",").alias("counts"))


@query(
    "d19_hits_per_individual",
    f"WITH {P} SELECT series_id, count(*) FILTER (y = y_pred) AS correct, count(*) FILTER (y != y_pred) AS incorrect,"
    f" {q6('100.0 * count(*) FILTER (y = y_pred) / count(*)')} AS ratio FROM p GROUP BY 1",
)
def _(spark, sf):
    return evaluate.individual_hits(predictions(spark, sf), ["series_id"]).withColumn("ratio", r6("ratio"))


@query(
    "d19_hits_per_month",
    f"WITH {V} SELECT series_id, month(visit_date)::INT AS month, count(*) FILTER (score = visit_id % 5 + 1) AS correct, count(*) FILTER (score != visit_id % 5 + 1)"
    f" AS incorrect, {q6('100.0 * count(*) FILTER (score = visit_id % 5 + 1) / count(*)')} AS ratio FROM v GROUP BY 1, 2",
)
def _(spark, sf):
    v = visits(spark, sf).withColumns({"month": F.month("visit_date"), "y_pred": F.col("visit_id") % 5 + 1, "y": F.col("score")})
    return evaluate.individual_hits(v, ["series_id", "month"]).withColumn("ratio", r6("ratio"))


@query(
    "d20_ensemble_vote",
    f"WITH {P} SELECT series_id, toxic, (avg(y_pred) > 0.5)::INT AS vote, {q6('avg(score / 20000)')} AS prob FROM p GROUP BY 1, 2",
)
def _(spark, sf):
    p = predictions(spark, sf).withColumn("prob", F.col("score") / 20000)
    return evaluate.ensemble_vote(p, ["series_id", "toxic"], pred="y_pred", prob="prob").withColumn("prob", r6("prob"))


_SUNS = (
    "d AS (SELECT ts::DATE AS day, min(s) FILTER (s >= 18000) AS sunrise, max(s) FILTER (s < 72000) AS sunset FROM (SELECT ts,"
    " ((epoch_us(ts) // 1000000) % 86400)::BIGINT AS s FROM events) GROUP BY 1),"
    " a AS (SELECT min(sunrise) AS sunrise_min, max(sunrise) AS sunrise_max, min(sunset) AS sunset_min, max(sunset) AS sunset_max FROM d),"
    " b AS (SELECT *, (sunset_min - sunrise_max) // 3600 + 1 AS hd, (sunrise_min + 86400 - sunset_max) // 3600 + 1 AS hn FROM a)"
)


@query(
    "d22_sun_envelope",
    f"WITH {_SUNS} SELECT sunrise_min, sunrise_max, sunset_min, sunset_max, (sunrise_max + hd // 2 * 3600) % 86400 AS mid_day,"
    " (sunrise_max + (hd // 2 - hd // 4) * 3600) % 86400 AS day_from, (sunrise_max + (hd // 2 + hd // 4) * 3600) % 86400 AS day_to,"
    " (sunset_max + hn // 2 * 3600) % 86400 AS mid_night, (sunset_max + (hn // 2 - hn // 4) * 3600) % 86400 AS night_from,"
    " (sunset_max + (hn // 2 + hn // 4) * 3600) % 86400 AS night_to FROM b",
)
def _(spark, sf):
    s = series(spark, sf).withColumn("s", F.pmod(F.unix_seconds("ts"), F.lit(86400)))
    days = s.groupBy(F.to_date("ts").alias("day")).agg(
        F.min(F.when(F.col("s") >= 18000, F.col("s"))).alias("sunrise"), F.max(F.when(F.col("s") < 72000, F.col("s"))).alias("sunset")
    )
    return stats.sun_envelope(days)


@query(
    "d23_light_statistics",
    f"WITH {S}, k AS (SELECT {qday('ts')} AS day, {PHASE} AS light, value FROM s) SELECT day, light, count(*) AS n, {q6('avg(value)')} AS mean,"
    f" {q6('median(value)')} AS median, {q6('stddev_pop(value)')} AS std FROM k GROUP BY 1, 2",
)
def _(spark, sf):
    sod = F.pmod(F.unix_seconds("ts"), F.lit(86400))
    k = series(spark, sf).withColumns({"day": day_text("ts"), "light": light_phase(sod, *[F.lit(x) for x in SUN])})
    out = stats.light_stats(k, ["day", "light"], "value")
    return out.withColumns({c: r6(c) for c in ("mean", "median", "std")})


@query(
    "d23_half_window_statistics",
    f"WITH {HOURLY}, k AS (SELECT series_id, CASE WHEN pos < (max(pos) OVER (PARTITION BY series_id) + 1) // 2 THEN 'before' ELSE 'after' END AS half, value FROM g)"
    f" SELECT series_id, half, count(value) AS n, {q6('avg(value)')} AS mean, {q6('median(value)')} AS median, {q6('stddev_pop(value)')} AS std FROM k GROUP BY 1, 2",
)
def _(spark, sf):
    g = hourly_grid(spark, sf)
    size = g.groupBy("series_id").agg((F.max("pos") + 1).alias("size"))
    half = F.when(F.col("pos") < F.floor(F.col("size") / 2), "before").otherwise("after")
    out = stats.light_stats(g.join(size, "series_id").withColumn("half", half), ["series_id", "half"], "value")
    return out.withColumns({c: r6(c) for c in ("mean", "median", "std")})


@query(
    "d24_large_groups",
    f"WITH {R}, b AS (SELECT config FROM r GROUP BY 1 HAVING count(*) >= 50) SELECT config, count(*) AS n, {q6('sum(price)')} AS price FROM r JOIN b USING (config) GROUP BY 1",
)
def _(spark, sf):
    kept = stats.keep_large_groups(reports(spark, sf), ["config"], 50)
    return kept.groupBy("config").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("price")).alias("price"))


@query("d25_activity_ranking", f"WITH {S} SELECT series_id, count(*) FILTER (value - 20 > 0) AS active FROM s GROUP BY 1")
def _(spark, sf):
    return stats.activity_ranking(series(spark, sf).withColumn("value", F.col("value") - 20))


# -- configurations ----------------------------------------------------------

CF = "cf AS (SELECT farm_id || method AS config, farm_id, fold, sum(floor(price)::BIGINT % 1000)::DOUBLE / count(*) / 1000 AS auc FROM r GROUP BY 1, 2, 3)"


def fold_scores(spark, sf):
    r = reports(spark, sf).withColumn("config", F.concat("farm_id", "method"))
    units = F.sum(F.floor("price") % 1000).cast("double") / F.count(F.lit(1)) / 1000
    return r.groupBy("config", "farm_id", "fold").agg(units.alias("auc"))


@query(
    "e17_lowest_configuration",
    f"WITH {R}, {CF}, m AS (SELECT farm_id, config, median(auc) AS median FROM cf GROUP BY 1, 2) SELECT farm_id, config, {q6('median')} AS median FROM m"
    " QUALIFY row_number() OVER (PARTITION BY farm_id ORDER BY median, config) = 1",
)
def _(spark, sf):
    return stats.best_configuration(fold_scores(spark, sf), "farm_id", "config", "auc", highest=False).withColumn("median", r6("median"))


@query(
    "e18_delta_to_best",
    f"WITH {R}, {CF}, best AS (SELECT config FROM cf GROUP BY 1 ORDER BY median(auc) DESC, config LIMIT 1), ob AS (SELECT fold, auc AS b FROM cf"
    f" WHERE config IN (SELECT config FROM best)) SELECT config, fold, {q6('auc - b')} AS delta FROM cf JOIN ob USING (fold)",
)
def _(spark, sf):
    out = stats.delta_to_best(fold_scores(spark, sf), "config", "fold", "auc")
    return out.select("config", "fold", r6("delta").alias("delta"))


@query("f1_sorted", f"WITH {R} SELECT l_orderkey, fold, l_partkey, l_suppkey, {q6('price')} AS price FROM r ORDER BY price DESC, l_orderkey, fold")
def _(spark, sf):
    out = reports(spark, sf).orderBy(F.col("price").desc(), "l_orderkey", "fold")
    return out.select("l_orderkey", "fold", "l_partkey", "l_suppkey", r6("price").alias("price"))


@query(
    "f2_top_configurations",
    f"WITH {R} SELECT l_orderkey, fold, l_partkey, l_suppkey, {q6('price')} AS price FROM r ORDER BY price DESC, l_orderkey, fold, l_partkey LIMIT 20",
)
def _(spark, sf):
    out = stats.top_rows(reports(spark, sf), 20, [F.col("price").desc(), F.col("l_orderkey"), F.col("fold"), F.col("l_partkey")])
    return out.select("l_orderkey", "fold", "l_partkey", "l_suppkey", r6("price").alias("price"))


@query(
    "f2_top_per_farm",
    f"WITH {R} SELECT farm_id, l_orderkey, fold, {q6('price')} AS price FROM r QUALIFY row_number() OVER (PARTITION BY farm_id ORDER BY price DESC, l_orderkey, fold, l_partkey) <= 3",
)
def _(spark, sf):
    order = [F.col("price").desc(), F.col("l_orderkey"), F.col("fold"), F.col("l_partkey")]
    out = stats.top_per_group(reports(spark, sf), ["farm_id"], order, 3)
    return out.select("farm_id", "l_orderkey", "fold", r6("price").alias("price"))


@query(
    "f3_top_series_by_entropy",
    f"WITH k AS (SELECT user_id AS series_id, floor(value / 10) AS v FROM events), {_ENT}, e AS (SELECT series_id, -sum(p * ln(p)) AS entropy FROM t GROUP BY 1),"
    f" f AS (SELECT e.series_id, {q6('entropy')} AS entropy, (c_custkey IS NOT NULL)::INT AS scored FROM e LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 9)"
    " ON c_custkey = series_id) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY scored ORDER BY entropy DESC, series_id) <= 5",
)
def _(spark, sf):
    k = series(spark, sf).withColumn("v", F.floor(F.col("value") / 10))
    e = stats.entropy(k, ["series_id"], "v").withColumn("entropy", r6("entropy"))
    scored = table(spark, sf, "customer").filter(F.col("c_nationkey") < 9).select(F.col("c_custkey").alias("series_id"), F.lit(1).alias("scored"))
    flagged = e.join(scored, "series_id", "left").withColumn("scored", F.coalesce("scored", F.lit(0)))
    return stats.top_per_group(flagged, ["scored"], [F.col("entropy").desc(), F.col("series_id")], 5)


_LKEY = ["l_orderkey", "fold", "l_partkey", "l_suppkey"]
_LDRAW = sql_draw("'5'", *_LKEY)


@query(
    "f6_sample_rows",
    f"WITH {R} SELECT l_orderkey, fold, l_partkey, l_suppkey FROM r ORDER BY {_LDRAW}, l_orderkey, fold, l_partkey, l_suppkey LIMIT 100",
)
def _(spark, sf):
    return stats.sample_rows(reports(spark, sf), 100, 5, _LKEY).select(*_LKEY)


@query("f6_sample_share", f"WITH {R} SELECT l_orderkey, fold, l_partkey, l_suppkey FROM r WHERE {_LDRAW} < {int(0.1 * 2**32)}")
def _(spark, sf):
    return stats.sample_share(reports(spark, sf), 0.1, 5, _LKEY).select(*_LKEY)


@query(
    "f7_balanced_classes",
    f"WITH {P}, n AS (SELECT sample_id, y, row_number() OVER (PARTITION BY y ORDER BY {sql_draw(chr(39) + '3' + chr(39), 'sample_id')}, sample_id) AS rn FROM p)"
    " SELECT sample_id, y FROM n WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM p GROUP BY y))",
)
def _(spark, sf):
    return splits.balanced(predictions(spark, sf), "y", 3).select("sample_id", "y")


@query(
    "f7_balanced_first",
    f"WITH {P}, n AS (SELECT sample_id, y, row_number() OVER (PARTITION BY y ORDER BY sample_id) AS rn FROM p)"
    " SELECT sample_id, y FROM n WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM p GROUP BY y))",
)
def _(spark, sf):
    p = predictions(spark, sf)
    return splits.balanced_first(p, "y", "sample_id", F.floor(F.col("sample_id") / 10_000)).select("sample_id", "y")


# -- sets --------------------------------------------------------------------


@query(
    "g1_union_of_sources",
    "SELECT lower(o_orderstatus) AS source, o_orderkey AS visit_id FROM orders",
)
def _(spark, sf):
    return table(spark, sf, "orders").select(F.lower("o_orderstatus").alias("source"), F.col("o_orderkey").alias("visit_id"))


@query(
    "g1_union_of_tables",
    "SELECT 'visits' AS source, o_orderkey AS id, o_custkey AS series_id, o_orderdate::DATE::VARCHAR AS day FROM orders"
    " UNION ALL SELECT 'records', event_id, user_id, ts::DATE::VARCHAR FROM events",
)
def _(spark, sf):
    visit = visits(spark, sf).select(F.col("visit_id").alias("id"), "series_id", F.col("visit_date").cast("string").alias("day"))
    record = series(spark, sf).select(F.col("event_id").alias("id"), F.to_date("ts").cast("string").alias("day"), "series_id")
    return sets.union_sources({"visits": visit, "records": record})


@query("g2_common_ids", "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return sets.common_ids(a, table(spark, sf, "orders").select(F.col("o_custkey").alias("id")))


@query(
    "g3_missing_ids",
    "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
)
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    done = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    return sets.missing_ids(a, done.select(F.col("o_custkey").alias("id")), "id")


@query("g4_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem")
def _(spark, sf):
    return sets.distinct_rows(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"])


# -- splits ------------------------------------------------------------------


@query(
    "m2_kfold",
    f"WITH {X}, s AS (SELECT DISTINCT sample_id, label FROM x), r AS (SELECT *, unnest(range(1, 4)) AS repeat FROM s) SELECT repeat::INT AS repeat, sample_id,"
    f" ((row_number() OVER (PARTITION BY repeat, label ORDER BY {sql_draw(chr(39) + '9' + chr(39), 'repeat', 'sample_id')}, sample_id) - 1) % 5)::INT AS fold FROM r",
)
def _(spark, sf):
    return splits.kfold(samples(spark, sf), 5, repeats=3, seed=9, stratify="label")


_IND = f"{V}, ind AS (SELECT series_id, count(*) AS n, count(*) FILTER (score > 3) AS p FROM v GROUP BY 1), tot AS (SELECT sum(n)::BIGINT AS tn, sum(p)::BIGINT AS tp FROM ind)"


def _targets(spark, sf):
    return visits(spark, sf).withColumn("target", (F.col("score") > 3).cast("int"))


@query(
    "m3_leave_one_out",
    f"WITH {_IND} SELECT series_id, n, p AS positives, tn - n AS train_n, tp - p AS train_pos FROM ind, tot WHERE tp - p > 0 AND tp - p < tn - n",
)
def _(spark, sf):
    return splits.leave_one_out(_targets(spark, sf)).select("series_id", "n", "positives", "train_n", "train_pos")


_PIND = f"{P}, ind AS (SELECT (sample_id // 4)::BIGINT AS series_id, count(*) AS n, sum(y)::BIGINT AS p FROM p GROUP BY 1), tot AS (SELECT sum(n)::BIGINT AS tn, sum(p)::BIGINT AS tp FROM ind)"
_PAIRS = "SELECT a.series_id AS a, b.series_id AS b, a.n + b.n AS test_n, a.p + b.p AS test_pos, tn - a.n - b.n AS train_n, tp - a.p - b.p AS train_pos FROM ind a JOIN ind b ON a.series_id < b.series_id, tot WHERE tp - a.p - b.p > 0 AND tp - a.p - b.p < tn - a.n - b.n"


def _individuals(spark, sf):
    return predictions(spark, sf).select(F.floor(F.col("sample_id") / 4).alias("series_id"), F.col("y").alias("target"))


@query("m3_leave_two_out", f"WITH {_PIND} {_PAIRS}")
def _(spark, sf):
    return splits.leave_two_out(_individuals(spark, sf))


@query("m3_leave_two_out_stratified", f"WITH {_PIND} {_PAIRS} AND ((a.p = 0 AND b.p = b.n) OR (a.p = a.n AND b.p = 0))")
def _(spark, sf):
    return splits.leave_two_out(_individuals(spark, sf), stratified=True)


_NIND = f"{P}, ind AS (SELECT series_id, count(*) AS n, sum(y)::BIGINT AS p FROM p GROUP BY 1), tot AS (SELECT sum(n)::BIGINT AS tn, sum(p)::BIGINT AS tp FROM ind)"


@query(
    "m3_leave_three_out",
    f"WITH {_NIND} SELECT concat_ws('-', a.series_id, b.series_id, c.series_id) AS members, a.n + b.n + c.n AS test_n, a.p + b.p + c.p AS test_pos,"
    " tn - a.n - b.n - c.n AS train_n, tp - a.p - b.p - c.p AS train_pos FROM ind a JOIN ind b ON a.series_id < b.series_id JOIN ind c ON b.series_id < c.series_id, tot"
    " WHERE tp - a.p - b.p - c.p > 0 AND tp - a.p - b.p - c.p < tn - a.n - b.n - c.n",
)
def _(spark, sf):
    p = predictions(spark, sf).withColumnRenamed("y", "target")
    out = splits.leave_n_out(p, 3)
    return out.withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), "-"))


_TRIPLE = (
    f"WITH {V}, ind AS (SELECT series_id, count(*) AS n, count(*) FILTER (score >= 4) AS p FROM v GROUP BY 1), tot AS (SELECT sum(n)::BIGINT AS tn, sum(p)::BIGINT AS tp, count(*) AS m FROM ind),"
    f" num AS (SELECT *, row_number() OVER (ORDER BY {sql_draw(chr(39) + 'combination' + chr(39), 'series_id')}, series_id) - 1 AS c FROM ind),"
    f" dr AS (SELECT i, ((({sql_draw(chr(39) + '5-high' + chr(39), 'i')})::HUGEINT * 4294967296 + {sql_draw(chr(39) + '5-low' + chr(39), 'i')}) % (m * (m - 1) * (m - 2) // 6))::BIGINT AS number FROM range(0, 4000) t(i), tot),"
    " fi AS (SELECT number, min(i) AS i FROM dr GROUP BY 1 ORDER BY 2 LIMIT 1000),"
    " c3 AS (SELECT number, max(c) AS c FROM fi JOIN num ON c * (c - 1) * (c - 2) // 6 <= number GROUP BY 1), r3 AS (SELECT number, c AS a, number - c * (c - 1) * (c - 2) // 6 AS rest FROM c3),"
    " c2 AS (SELECT number, a, rest, max(c) AS b FROM r3 JOIN num ON c * (c - 1) // 2 <= rest GROUP BY ALL), c1 AS (SELECT a, b, rest - b * (b - 1) // 2 AS c FROM c2)"
)


@query(
    "m3_drawn_triples",
    f"{_TRIPLE} SELECT array_to_string(list_sort([x.series_id, y.series_id, z.series_id]), '-') AS members, x.n + y.n + z.n AS test_n, x.p + y.p + z.p AS test_pos, tn - x.n - y.n - z.n AS train_n, tp - x.p - y.p - z.p AS train_pos"
    " FROM c1 JOIN num x ON x.c = c1.a JOIN num y ON y.c = c1.b JOIN num z ON z.c = c1.c, tot WHERE train_pos > 0 AND train_pos < train_n",
)
def _(spark, sf):
    v = visits(spark, sf).withColumn("target", (F.col("score") >= 4).cast("int"))
    out = splits.leave_n_out(v, 3, drawn=1000, seed=5).drop("rank")
    return out.withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), "-"))


def _resample_sql(ids, key, seed, less=0):
    s = f"'{seed}'"
    return (
        f"num AS (SELECT {key}, row_number() OVER (ORDER BY {sql_draw(s, key)}, {key}) AS no FROM {ids}), cc AS (SELECT count(*) AS c FROM num),"
        f" pk AS (SELECT replicate, {sql_draw(s, 'replicate', 'no')} % c + 1 AS pick FROM num, cc, (SELECT unnest(range(1, 101)) AS replicate) WHERE no <= c - {less}),"
        f" wt AS (SELECT replicate, {key}, count(*) AS times FROM pk JOIN num ON num.no = pick GROUP BY 1, 2)"
    )


@query(
    "m4_individual_bootstrap",
    f"WITH ids AS (SELECT DISTINCT user_id AS series_id FROM events), {_resample_sql('ids', 'series_id', 4, 1)}, un AS (SELECT replicate, series_id FROM ids,"
    " (SELECT unnest(range(1, 101)) AS replicate) WHERE (replicate, series_id) NOT IN (SELECT replicate, series_id FROM wt)),"
    f" ts AS (SELECT replicate, series_id FROM un QUALIFY row_number() OVER (PARTITION BY replicate ORDER BY {sql_draw(chr(39) + 'test' + chr(39), 'replicate', 'series_id')}, series_id) = 1)"
    " SELECT replicate::INT AS replicate, series_id, times, 'train' AS split FROM wt UNION ALL SELECT replicate::INT, series_id, 1, 'test' FROM ts",
)
def _(spark, sf):
    ids = series(spark, sf).select("series_id").distinct()
    return splits.individual_bootstrap(ids, 100, 4)


@query(
    "m7_cross_farm_split",
    f"WITH {R}, f AS (SELECT DISTINCT farm_id AS direction FROM r WHERE farm_id IS NOT NULL) SELECT direction, farm_id, CASE WHEN farm_id = direction THEN 'train' ELSE 'test' END AS split,"
    f" count(*) AS n, {q6('avg(price)')} AS price FROM r, f GROUP BY 1, 2, 3",
)
def _(spark, sf):
    out = splits.cross_source_split(reports(spark, sf), source="farm_id")
    return out.groupBy("direction", "farm_id", "split").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("price")).alias("price"))


@query(
    "m8_training_subsets",
    f"WITH {P}, d AS (SELECT subset, sample_id, y FROM p, (SELECT unnest(range(1, 11))::INT AS subset) WHERE {sql_draw(chr(39) + '8' + chr(39), 'subset', 'sample_id')} < {int(0.1 * 2**32)}),"
    " ok AS (SELECT subset FROM d GROUP BY 1 HAVING min(y) < max(y)) SELECT subset, sample_id, y FROM d WHERE subset IN (SELECT subset FROM ok)",
)
def _(spark, sf):
    return splits.training_subsets(predictions(spark, sf), 10, 0.1, 8)


# -- metrics -----------------------------------------------------------------

_CM = "c AS (SELECT {k} count(*) FILTER (y = 1 AND y_pred = 1) AS tp, count(*) FILTER (y = 0 AND y_pred = 1) AS fp, count(*) FILTER (y = 0 AND y_pred = 0) AS tn, count(*) FILTER (y = 1 AND y_pred = 0) AS fn FROM p {g}),"
_CM += (
    " m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision_1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall_1,"
    " CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS precision_0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS recall_0 FROM c)"
)
_F1 = "CASE WHEN precision_{c} + recall_{c} > 0 THEN 2 * precision_{c} * recall_{c} / (precision_{c} + recall_{c}) ELSE 0 END"
_METRICS = ("precision_0", "recall_0", "f1_0", "precision_1", "recall_1", "f1_1", "balanced_accuracy")


@query(
    "m11_confusion",
    f"WITH {P}, {_CM.format(k='fold,', g='GROUP BY fold')} SELECT fold, tp, fp, tn, fn, tp + fn AS support_1, tn + fp AS support_0, {q6('precision_1')} AS precision_1,"
    f" {q6('recall_1')} AS recall_1, {q6('precision_0')} AS precision_0, {q6('recall_0')} AS recall_0, {q6(_F1.format(c=0))} AS f1_0, {q6(_F1.format(c=1))} AS f1_1,"
    f" {q6('(recall_0 + recall_1) / 2')} AS balanced_accuracy FROM m",
)
def _(spark, sf):
    return evaluate.confusion(predictions(spark, sf), ["fold"]).withColumns({c: r6(c) for c in _METRICS})


def _roc_sql(key="fold"):
    return (
        f"sc AS (SELECT {key}, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM p GROUP BY 1, 2),"
        f" cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {key}) AS pt, sum(neg) OVER (PARTITION BY {key}) AS nt"
        f" FROM sc WINDOW w AS (PARTITION BY {key} ORDER BY score DESC))"
    )


@query("m12_roc_curve", f"WITH {P}, {_roc_sql()} SELECT fold, score AS threshold, {q6('CASE WHEN nt > 0 THEN fp / nt END')} AS fpr, {q6('CASE WHEN pt > 0 THEN tp / pt END')} AS tpr FROM cu")
def _(spark, sf):
    out = evaluate.roc_curve(predictions(spark, sf), ["fold"])
    return out.withColumns({"fpr": r6("fpr"), "tpr": r6("tpr")})


@query(
    "m12_auc_per_fold",
    f"WITH {P}, {_roc_sql()} SELECT fold, max(pt)::BIGINT AS positives, max(nt)::BIGINT AS negatives, {q6('CASE WHEN max(pt) * max(nt) > 0 THEN sum(neg * (tp - pos + pos / 2)) / (max(pt) * max(nt)) END')} AS auc FROM cu GROUP BY 1",
)
def _(spark, sf):
    return evaluate.auc(predictions(spark, sf), ["fold"]).withColumn("auc", r6("auc"))


@query(
    "m12_auc_pooled",
    f"WITH {P}, pr AS (SELECT sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE AS u, count(*) AS n FROM (SELECT score FROM p"
    f" WHERE y = 1) a, (SELECT score FROM p WHERE y = 0) b) SELECT (SELECT count(*) FROM p WHERE y = 1) AS positives, (SELECT count(*) FROM p WHERE y = 0) AS negatives, {q6('u / n')} AS auc FROM pr",
)
def _(spark, sf):
    return evaluate.auc(predictions(spark, sf), []).withColumn("auc", r6("auc"))


_MEAN_ROC = (
    f"WITH {P}, {_roc_sql()}, ok AS (SELECT * FROM cu WHERE pt > 0 AND nt > 0), pts AS (SELECT fold, fp, tp, pt, nt FROM ok UNION ALL SELECT fold, 0, 0, max(pt), max(nt) FROM ok"
    " GROUP BY 1), st AS (SELECT fold, fp, pt, nt, max(tp) AS top, min(tp) AS low FROM pts GROUP BY 1, 2, 3, 4), nx AS (SELECT *, lead(fp) OVER w AS nfp, lead(low) OVER w AS nlow"
    " FROM st WINDOW w AS (PARTITION BY fold ORDER BY fp)), gr AS (SELECT unnest(range(0, 100))::INT AS i), it AS (SELECT fold, i, CASE WHEN i = 0 THEN 0 ELSE"
    " (top + coalesce((nlow - top)::DOUBLE / (nfp - fp) * (i / 99.0::DOUBLE * nt - fp), 0)) / pt END AS tpr FROM nx JOIN gr ON i * nt >= fp * 99 AND (nfp IS NULL OR i * nt < nfp * 99))"
)


@query("m13_interpolated_roc", f"{_MEAN_ROC} SELECT fold, i, {q6('tpr')} AS tpr FROM it")
def _(spark, sf):
    return evaluate.interpolated_roc(predictions(spark, sf), "fold").withColumn("tpr", r6("tpr"))


@query("m13_mean_roc", f"{_MEAN_ROC} SELECT i, count(*) AS folds, {q6('CASE WHEN i = 99 THEN 1 ELSE avg(tpr) END')} AS tpr FROM it GROUP BY 1")
def _(spark, sf):
    return evaluate.mean_roc(predictions(spark, sf), "fold").withColumn("tpr", r6("tpr"))


@query(
    "m14_precision_recall",
    f"WITH {P}, {_roc_sql()} SELECT fold, score AS threshold, {q6('tp / (tp + fp)')} AS precision, CASE WHEN pt > 0 THEN {q6('tp / pt')} END AS recall FROM cu",
)
def _(spark, sf):
    out = evaluate.precision_recall(predictions(spark, sf), ["fold"])
    return out.withColumns({"precision": r6("precision"), "recall": r6("recall")})


@query(
    "m14_average_precision",
    f"WITH {P}, {_roc_sql()} SELECT fold, {q6('CASE WHEN max(pt) > 0 THEN sum(pos * tp / (tp + fp)) / max(pt) END')} AS average_precision FROM cu GROUP BY 1",
)
def _(spark, sf):
    out = evaluate.average_precision(predictions(spark, sf), ["fold"])
    return out.withColumn("average_precision", r6("average_precision"))


@query(
    "m15_percentile_interval",
    f"WITH {R} SELECT config, count(*) AS n, {q6('quantile_cont(price, 0.025)')} AS low, {q6('quantile_cont(price, 0.5)')} AS median, {q6('quantile_cont(price, 0.975)')} AS high FROM r GROUP BY 1",
)
def _(spark, sf):
    out = stats.percentile_interval(reports(spark, sf), ["config"], "price")
    return out.withColumns({c: r6(c) for c in ("low", "median", "high")})


@query(
    "i23_interval_text",
    f"WITH {R} SELECT config, printf('%.2f (%.2f-%.2f)', avg(price + 0.0013), quantile_cont(price + 0.0013, 0.025), quantile_cont(price + 0.0013, 0.975)) AS text FROM r GROUP BY 1",
)
def _(spark, sf):
    r = reports(spark, sf).withColumn("price", F.col("price") + 0.0013)
    out = stats.percentile_interval(r, ["config"], "price").join(r.groupBy("config").agg(F.avg("price").alias("mean")), "config")
    return out.select("config", scalar.mean_interval_text(F.col("mean"), F.col("low"), F.col("high")).alias("text"))


_BOOT = (
    f"WITH {P}, ids AS (SELECT DISTINCT fold FROM p), {_resample_sql('ids', 'fold', 16)}, sc AS (SELECT replicate, score, sum(times) FILTER (y = 1) AS pos0, sum(times) FILTER (y = 0) AS neg0 FROM p"
    " JOIN wt USING (fold) GROUP BY 1, 2), sd AS (SELECT replicate, score, coalesce(pos0, 0) AS pos, coalesce(neg0, 0) AS neg FROM sc), cu AS (SELECT *, sum(pos) OVER (PARTITION BY replicate ORDER BY score DESC) AS tp FROM sd),"
    " au AS (SELECT replicate, sum(neg * (tp - pos + pos / 2)) / (sum(pos) * sum(neg)) AS auc FROM cu GROUP BY 1), pr AS (SELECT replicate, sum(times * y) / sum(times) AS precision FROM p JOIN wt USING (fold) WHERE y_pred = 1 GROUP BY 1)"
)


@query("m16_bootstrap_metrics", f"{_BOOT} SELECT replicate::INT AS replicate, {q6('auc')} AS auc, {q6('precision')} AS precision FROM au LEFT JOIN pr USING (replicate)")
def _(spark, sf):
    out = evaluate.bootstrap_metrics(predictions(spark, sf), "fold", 100, 16)
    return out.withColumns({"auc": r6("auc"), "precision": r6("precision")})


@query(
    "m16_bootstrap_interval",
    f"{_BOOT} SELECT count(auc) AS n, {q6('quantile_cont(auc, 0.025)')} AS low, {q6('quantile_cont(auc, 0.5)')} AS median, {q6('quantile_cont(auc, 0.975)')} AS high FROM au",
)
def _(spark, sf):
    metrics = materialise(evaluate.bootstrap_metrics(predictions(spark, sf), "fold", 100, 16), "bootstrap")
    out = evaluate.bootstrap_interval(metrics, "auc")
    return out.withColumns({c: r6(c) for c in ("low", "median", "high")})


def _split_boot(side):
    """The replicates' AUC over the rows of one side."""
    return (
        f", sc_{side} AS (SELECT replicate, score, coalesce(sum(times) FILTER (y = 1), 0) AS pos, coalesce(sum(times) FILTER (y = 0), 0) AS neg FROM p JOIN wt USING (fold)"
        f" WHERE (CASE WHEN sample_id % 3 = 0 THEN 'test' ELSE 'train' END) = '{side}' GROUP BY 1, 2), cu_{side} AS (SELECT *, sum(pos) OVER (PARTITION BY replicate ORDER BY score DESC) AS tp FROM sc_{side}),"
        f" au_{side} AS (SELECT replicate, sum(neg * (tp - pos + pos / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM cu_{side} GROUP BY 1)"
    )


@query(
    "m16_bootstrap_both_splits",
    f"{_BOOT}{_split_boot('test')}{_split_boot('train')}, pt AS (SELECT replicate, sum(times * y) / sum(times) AS precision FROM p JOIN wt USING (fold) WHERE y_pred = 1 AND sample_id % 3 = 0 GROUP BY 1)"
    f" SELECT t.replicate::INT AS replicate, {q6('t.auc')} AS auc, {q6('r.auc')} AS train_auc, {q6('pt.precision')} AS precision"
    " FROM au_test t LEFT JOIN au_train r USING (replicate) LEFT JOIN pt USING (replicate)",
)
def _(spark, sf):
    p = predictions(spark, sf).withColumn("split", F.when(F.col("sample_id") % 3 == 0, "test").otherwise("train"))
    out = evaluate.bootstrap_metrics(p, "fold", 100, 16, split="split")
    return out.select("replicate", *[r6(c).alias(c) for c in ("auc", "train_auc", "precision")])


@query(
    "m17_report",
    f"WITH {R}, f AS (SELECT config, l_orderkey % 5 AS k, avg(auc) AS m FROM r GROUP BY 1, 2), l AS (SELECT config, string_agg(floor(m * 1000 + 0.5)::BIGINT::VARCHAR, ',' ORDER BY k) AS auc_list FROM f GROUP BY 1)"
    f" SELECT config, {q6('avg(auc)')} AS auc_mean, {q6('avg(precision_1)')} AS precision_1_mean, {q6('sum(fit_time)')} AS fit_time_total, any_value(auc_list) AS auc_list FROM r JOIN l USING (config) GROUP BY 1",
)
def _(spark, sf):
    r = reports(spark, sf).withColumn("k", F.col("l_orderkey") % 5)
    out = stats.report(r, "config", "k", ["auc", "precision_1"], "fit_time")
    text = F.array_join(F.transform("auc_list", lambda m: F.floor(m * 1000 + 0.5).cast("string")), ",")
    return out.select("config", r6("auc_mean").alias("auc_mean"), r6("precision_1_mean").alias("precision_1_mean"), r6("fit_time_total").alias("fit_time_total"), text.alias("auc_list"))


@query(
    "m18_best_configuration",
    f"WITH {R}, {CF}, m AS (SELECT farm_id, config, median(auc) AS median FROM cf GROUP BY 1, 2) SELECT farm_id, config, {q6('median')} AS median FROM m"
    " QUALIFY row_number() OVER (PARTITION BY farm_id ORDER BY median DESC, config) = 1",
)
def _(spark, sf):
    return stats.best_configuration(fold_scores(spark, sf), "farm_id", "config", "auc").withColumn("median", r6("median"))


@query(
    "m19_grid_search_summary",
    f"WITH {R}, k AS (SELECT fold AS c, (fit_time::INT % 9)::INT AS gamma, auc FROM r WHERE NOT (fold = 1 AND fit_time::INT % 9 > 6)) SELECT c, gamma, {q6('median(greatest(auc, 0.5))')} AS median FROM k"
    " WHERE gamma IN (SELECT gamma FROM k WHERE c = 1) GROUP BY 1, 2",
)
def _(spark, sf):
    gamma = (F.col("fit_time").cast("int") % 9).alias("gamma")
    k = reports(spark, sf).select(F.col("fold").alias("c"), gamma, "auc").filter(~((F.col("c") == 1) & (F.col("gamma") > 6)))
    return stats.grid_search_summary(k, "c", "gamma", "auc", 1).select("c", "gamma", r6("median").alias("median"))


@query(
    "m20_metric_pivot",
    f"WITH {R} SELECT method, " + ", ".join(f"{q6(f'avg(price) FILTER (fold = {i})')} AS fold_{i}" for i in range(1, 8)) + " FROM r GROUP BY 1",
)
def _(spark, sf):
    out = reports(spark, sf).groupBy("method").pivot("fold").agg(F.avg("price"))
    return out.select("method", *[r6(c).alias(f"fold_{c}") for c in out.columns[1:]])


@query(
    "m20_metric_domain",
    f"WITH {R} SELECT method, " + ", ".join(f"{q6(f'avg(price) FILTER (fold = {i})')} AS fold_{i}" for i in range(1, 8))
    + f", {q6('avg(price) FILTER (fold IS NULL OR fold NOT BETWEEN 1 AND 7)')} AS fold_other FROM r GROUP BY 1",
)
def _(spark, sf):
    out = stats.metric_pivot(reports(spark, sf), ["method"], "fold", range(1, 8), "price")
    return out.select("method", *[r6(c).alias(c) for c in out.columns[1:]])


@query(
    "m21_mann_whitney",
    f"WITH {P}, a AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk, count(*) OVER (PARTITION BY score) AS t FROM p),"
    " b AS (SELECT count(*) FILTER (y = 1)::DOUBLE AS n1, count(*) FILTER (y = 0)::DOUBLE AS n2, sum(rk) FILTER (y = 1) AS r1, sum(t * t - 1)::DOUBLE AS ties FROM a),"
    " u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM b),"
    " v AS (SELECT n1, n2, u, greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sd AS z FROM u), w AS (SELECT *, 0.5 - z / 6000 / sqrt(2 * pi())"
    " * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-z * z * i * i / 8000000))) AS tail FROM v)"
    f" SELECT n1, n2, {q6('u')} AS u, {q6('z')} AS z, {q6('2 * tail')} AS p FROM w",
)
def _(spark, sf):
    out = evaluate.mann_whitney(predictions(spark, sf), [])
    return out.select("n1", "n2", r6("u").alias("u"), r6("z").alias("z"), r6("p").alias("p"))


_EXACT = (
    f"WITH RECURSIVE {P}, q AS (SELECT sample_id // 16 AS part, score, (y = 1)::INT AS one FROM p WHERE score IS NOT NULL AND y IN (0, 1)),"
    " z AS (SELECT part, count(*) FILTER (one = 1) AS n1, count(*) FILTER (one = 0) AS n2 FROM q GROUP BY 1 HAVING n1 BETWEEN 1 AND 20 AND n2 BETWEEN 1 AND 20),"
    " k AS (SELECT part, one, row_number() OVER (PARTITION BY part ORDER BY score, one) AS i, 2 * rank() OVER (PARTITION BY part ORDER BY score) + count(*) OVER (PARTITION BY part, score) - 1 AS r2 FROM q SEMI JOIN z USING (part)),"
    " w AS (SELECT part, 0 AS i, 0 AS picked, 0::BIGINT AS total, 1::HUGEINT AS ways FROM z UNION ALL"
    " SELECT part, i, picked, total, sum(ways)::HUGEINT AS ways FROM (SELECT w.part, k.i, w.picked + t.take AS picked, w.total + t.take * k.r2 AS total, w.ways FROM w JOIN k ON k.part = w.part AND k.i = w.i + 1, (VALUES (0), (1)) t(take))"
    " GROUP BY part, i, picked, total),"
    " o AS (SELECT part, sum(r2) FILTER (one = 1) AS seen FROM k GROUP BY 1),"
    " f AS (SELECT w.part, n1, n2, seen, total, ways FROM w JOIN z USING (part) JOIN o USING (part) WHERE w.i = n1 + n2 AND w.picked = n1)"
)


@query(
    "m21_exact_small_groups",
    f"{_EXACT} SELECT part, any_value(n1) AS n1, any_value(n2) AS n2, {q6('any_value(seen) / 2.0::DOUBLE - any_value(n1 * (n1 + 1)) / 2.0::DOUBLE')} AS u,"
    f" {q6('least(1.0::DOUBLE, 2 * least(sum(ways) FILTER (total <= seen), sum(ways) FILTER (total >= seen))::DOUBLE / sum(ways)::DOUBLE)')} AS p FROM f GROUP BY part",
)
def _(spark, sf):
    p = predictions(spark, sf).withColumn("part", F.floor(F.col("sample_id") / 16))
    out = evaluate.mann_whitney_exact(p, ["part"])
    return out.select("part", "n1", "n2", r6("u").alias("u"), r6("p").alias("p"))


@query(
    "m22_fold_accuracy",
    f"WITH {P}, a AS (SELECT fold, avg((y = y_pred)::INT) AS accuracy FROM p GROUP BY 1) SELECT DISTINCT fold, series_id, {q6('accuracy')} AS accuracy FROM p JOIN a USING (fold)",
)
def _(spark, sf):
    out = evaluate.accuracy_per_fold(predictions(spark, sf), "fold", "series_id")
    return out.withColumn("accuracy", r6("accuracy"))


@query("m25_rows_per_individual", f"WITH {S} SELECT series_id, count(*) AS n FROM s GROUP BY 1")
def _(spark, sf):
    return stats.rows_per_individual(series(spark, sf))


@query(
    "m26_signal_summary",
    f"WITH {S} SELECT series_id, count(value) AS points, {q6('min(value)')} AS low, {q6('max(value)')} AS high, epoch_us(min(ts))::BIGINT AS first_us, epoch_us(max(ts))::BIGINT AS last_us,"
    f" {q6('arg_min(value, ts)')} AS first_value, {q6('arg_max(value, ts)')} AS last_value, {qsecs('max(ts)')} - {qsecs('min(ts)')} AS span_s FROM s GROUP BY 1",
)
def _(spark, sf):
    out = stats.signal_summary(series(spark, sf))
    return out.select(
        "series_id", "points", r6("low").alias("low"), r6("high").alias("high"), F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us"), r6("first_value").alias("first_value"), r6("last_value").alias("last_value"), "span_s",
    )


@query(
    "m29_find_ids",
    "WITH l AS (SELECT source AS file, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT file, unnest(list_distinct(regexp_extract_all(line, '\\d+'))) AS t FROM l)"
    " SELECT c_custkey AS id, file, count(*) AS n FROM t JOIN customer ON TRY_CAST(t AS BIGINT) = c_custkey GROUP BY 1, 2",
)
def _(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("source").alias("file"), F.explode(F.split("text", "\n")).alias("line"))
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return stats.find_ids(lines, ids, text="line", file="file", key="id")


# -- models ------------------------------------------------------------------


def _folds(spark, sf):
    x = samples(spark, sf)
    folds = splits.kfold(x, 2, seed=1).select("sample_id", "fold")
    return materialise(x.join(folds, "sample_id").withColumn("y", (F.col("label") < 5).cast("int")), "folds")


@query("m10_linear_classifier")
def _(spark, sf):
    return models.fit_predict(_folds(spark, sf), "linear", 2, maxIter=20)


@query("m10_logistic_classifier")
def _(spark, sf):
    return models.fit_predict(_folds(spark, sf), "logistic", 2, maxIter=20)


@query("m10_tree_classifier")
def _(spark, sf):
    return models.fit_predict(_folds(spark, sf), "tree", 2, maxDepth=4)


_FOLDED = (
    f"WITH {X}, s AS (SELECT DISTINCT sample_id, (label < 5)::INT AS y FROM x), f AS (SELECT sample_id, y, ((row_number() OVER (ORDER BY {sql_draw(chr(39) + '1' + chr(39), '1', 'sample_id')}, sample_id) - 1) % 2)::INT AS fold FROM s)"
)


@query(
    "m10_logistic_certificate",
    f"{_FOLDED} SELECT a.fold, count(DISTINCT b.sample_id) AS n, true AS optimal FROM f a JOIN f b ON a.fold != b.fold GROUP BY a.fold",
)
def _(spark, sf):
    return certificates.logistic(_folds(spark, sf), 2, penalty=0.01)


@query("m10_linear_certificate", f"{_FOLDED} SELECT a.fold, count(DISTINCT b.sample_id) AS n, true AS optimal FROM f a JOIN f b ON a.fold != b.fold GROUP BY a.fold")
def _(spark, sf):
    return certificates.linear(_folds(spark, sf), 2, penalty=0.01)


@query("m10_tree_certificate", f"{_FOLDED} SELECT a.fold, count(DISTINCT b.sample_id) AS n, 0::BIGINT AS odd_leaves FROM f a JOIN f b ON a.fold != b.fold GROUP BY a.fold")
def _(spark, sf):
    return certificates.tree(_folds(spark, sf), 2, depth=4)


@query(
    "s8_certificate",
    "WITH c AS (SELECT unnest(range(0, 3))::INT AS component) SELECT component, (SELECT count(*) FROM embeddings) AS n, true AS eigenvector, true AS unit, true AS uncorrelated FROM c",
)
def _(spark, sf):
    return certificates.components(samples(spark, sf), 3)


@query("m23_certificate", "SELECT count(*) AS n, 0::BIGINT AS misplaced FROM embeddings")
def _(spark, sf):
    return certificates.clustering(materialise(models.principal_components(samples(spark, sf), 3), "reduced"), 4)


@query("s8_principal_components")
def _(spark, sf):
    out = models.principal_components(samples(spark, sf), 3)
    return out.select("sample_id", F.posexplode("features").alias("component", "x")).withColumn("x", r6("x"))


@query("m23_clusters")
def _(spark, sf):
    reduced = materialise(models.principal_components(samples(spark, sf), 3), "reduced")
    return models.clusters(reduced, 4).select("sample_id", "cluster")
