"""Queries over visits: transitions, labels, splits by time, joins with traces, labelled samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.operators import filters, grid, joins, labels, samples
from tracelab.plans.bindings import (
    HOURLY, S, V, VE, WX, hourly_grid, q6, qsecs, r6, secs, series, table, visits, visits_on_series, weather,
)
from tracelab.plans.registry import query
from tracelab.plans.trace_queries import COMMON, common_hourly
from tracelab.session import materialise

W = "OVER (PARTITION BY series_id ORDER BY visit_date, visit_id)"
LAB = (
    f"lv AS (SELECT *, lag(score, 1) {W} AS prev1, lag(score, 2) {W} AS prev2, lag(score, 3) {W} AS prev3,"
    f" lag(score, 4) {W} AS prev4 FROM v),\n"
    "lab AS (SELECT *, prev1::VARCHAR || 'To' || score::VARCHAR AS label FROM lv)"
)


def labelled(spark, sf):
    return labels.previous_scores(visits(spark, sf))


def day_text(c):
    return F.date_format(c, "yyyy-MM-dd")


def qday(expr):
    return f"strftime({expr}, '%Y-%m-%d')"

TRANSITIONS = [f"{a}To{b}" for a in range(1, 6) for b in range(1, 6)]


@query("e1_previous_scores", f"WITH {V}, {LAB} SELECT visit_id, prev1, prev2, prev3, prev4, label FROM lab")
def _(spark, sf):
    return labelled(spark, sf).select("visit_id", "prev1", "prev2", "prev3", "prev4", "label")


@query(
    "e2_next_visits",
    f"WITH {V}, d AS (SELECT visit_id, visit_date, lead(visit_date, 1) {W} AS d1, lead(visit_date, 2) {W} AS d2,"
    f" lead(visit_date, 3) {W} AS d3, lead(visit_date, 4) {W} AS d4 FROM v) SELECT visit_id, {qday('d1')} AS date1,"
    f" {qday('d2')} AS date2, {qday('d3')} AS date3, {qday('d4')} AS date4, (d1 - visit_date)::INT AS gap1,"
    " (d2 - d1)::INT AS gap2, (d3 - d2)::INT AS gap3, (d4 - d3)::INT AS gap4 FROM d",
)
def _(spark, sf):
    out = labels.next_visits(visits(spark, sf))
    return out.select("visit_id", *[day_text(f"date{i}").alias(f"date{i}") for i in range(1, 5)], *[f"gap{i}" for i in range(1, 5)])


@query(
    "e3_minimum_gap",
    f"WITH {V}, d AS (SELECT series_id, (lead(visit_date) {W} - visit_date)::INT AS gap FROM v)"
    " SELECT series_id, min(gap) AS min_gap FROM d GROUP BY 1",
)
def _(spark, sf):
    return labels.minimum_gap(visits(spark, sf))


@query(
    "e4_change_flags",
    f"WITH {V}, {LAB} SELECT visit_id, CASE WHEN prev1 = 1 AND score >= 2 THEN 1 WHEN prev1 = 1 AND score = 1 THEN 0 END"
    " AS increase, sign(score - prev1)::INT AS direction, CASE WHEN prev1 = 1 AND score >= 2 THEN 1 WHEN prev1 >= 2 AND"
    " score = 1 THEN 2 WHEN prev1 = 2 AND score = 2 THEN 3 WHEN prev1 = 1 AND score = 1 THEN 4 WHEN prev1 > 2 AND"
    " score > 2 THEN 5 END AS change FROM lab",
)
def _(spark, sf):
    return labels.change_flags(visits(spark, sf)).select("visit_id", "increase", "direction", "change")


@query(
    "e7_consecutive_mask",
    f"WITH {V}, d AS (SELECT series_id, visit_id, visit_date, (lead(visit_date) {W} - visit_date) AS gap FROM v),"
    f" e AS (SELECT visit_id, gap, lag(gap) {W} AS gb, lead(gap) {W} AS ga FROM d)"
    " SELECT visit_id, coalesce((gap = 7 AND ga = 7) OR (gb = 7 AND gap = 7), false)::INT AS consecutive FROM e",
)
def _(spark, sf):
    out = labels.consecutive_mask(visits(spark, sf), 7)
    return out.select("visit_id", F.col("consecutive").cast("int").alias("consecutive"))


@query(
    "e8_chain_pattern",
    f"WITH {VE}, d0 AS (SELECT *, visit_ts::DATE AS visit_date FROM ve), d AS (SELECT *, lead(score) {W} AS s2,"
    f" lead(visit_date) {W} AS d2, lead(visit_id) {W} AS v2 FROM d0) SELECT visit_id, concat_ws(',', score, visit_id % 5, s2, v2 % 5)"
    " AS chain, (visit_id % 3 + v2 % 3)::BIGINT AS imputed_days FROM d WHERE (score = 1 AND s2 = 2 AND d2 - visit_date = 1)"
    " OR (score = 2 AND s2 = 2 AND d2 - visit_date = 2)",
)
def _(spark, sf):
    v = visits_on_series(spark, sf).withColumns(
        {
            "visit_date": F.to_date("visit_ts"),
            "label": F.col("score").cast("string"),
            "features": F.array(F.col("score").cast("long"), F.col("visit_id") % 5),
            "imputed_days": F.col("visit_id") % 3,
        }
    )
    out = labels.chain_pattern(v, ["1", "2"], 1).unionByName(labels.chain_pattern(v, ["2", "2"], 2))
    return out.select("visit_id", F.array_join("features", ",").alias("chain"), "imputed_days")


HALF = (
    "hf AS (SELECT series_id, visit_id, visit_date, score, CASE WHEN row_number() OVER w <= count(*) OVER"
    " (PARTITION BY series_id) // 2 THEN 1 ELSE 2 END AS half FROM v"
    " WINDOW w AS (PARTITION BY series_id ORDER BY visit_date, visit_id))"
)


@query("e16_halves_by_date", f"WITH {V}, {HALF} SELECT visit_id, half FROM hf")
def _(spark, sf):
    return labels.halves(visits(spark, sf)).select("visit_id", "half")


@query(
    "m6_temporal_split",
    f"WITH {V}, {HALF} SELECT d AS direction, visit_id, CASE WHEN half = d THEN 'train' ELSE 'test' END AS split"
    " FROM hf, (VALUES (1), (2)) t(d)",
)
def _(spark, sf):
    from tracelab.operators.splits import temporal_split

    return temporal_split(visits(spark, sf)).select("direction", "visit_id", "split")


@query("i16_transition_code", f"WITH {V}, {LAB} SELECT visit_id, prev1 * 10 + score AS code, label FROM lab")
def _(spark, sf):
    code = labels.transition_code(F.col("prev1"), F.col("score"))
    out = labelled(spark, sf).withColumn("code", code)
    return out.select("visit_id", "code", labels.label_from_code(F.col("code")).alias("label"))


@query("i17_binary_target", f"WITH {V} SELECT visit_id, (score != 1)::INT AS target FROM v")
def _(spark, sf):
    return visits(spark, sf).select("visit_id", labels.binary_target(F.col("score"), 1).alias("target"))


@query(
    "i21_transition_direction",
    f"WITH {V}, {LAB} SELECT direction, count(*) AS n FROM (SELECT CASE WHEN left(label, 1) = right(label, 1) THEN 'equal'"
    " WHEN left(label, 1) < right(label, 1) THEN 'up' ELSE 'down' END AS direction FROM lab WHERE label IS NOT NULL) GROUP BY 1",
)
def _(spark, sf):
    known = labelled(spark, sf).filter(F.col("label").isNotNull())
    return known.groupBy(labels.transition_direction(F.col("label")).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


# -- filters and derived labels ----------------------------------------------


@query("b4_after_date", f"WITH {V} SELECT visit_id, {qday('visit_date')} AS day FROM v WHERE visit_date > DATE '1999-06-30'")
def _(spark, sf):
    return filters.after_date(visits(spark, sf), "1999-06-30", "visit_date").select("visit_id", day_text("visit_date").alias("day"))


@query(
    "b11_binary_health",
    f"WITH {V}, {LAB} SELECT visit_id, CASE WHEN label = '1To1' THEN 0 WHEN label IN ('2To2', '1To2') THEN 1 ELSE -1 END"
    " AS health FROM lab",
)
def _(spark, sf):
    health = labels.binary_health(F.col("label"), ["1To1"], ["2To2", "1To2"])
    return labelled(spark, sf).select("visit_id", health.alias("health"))


@query(
    "b12_dense_target",
    f"WITH {V}, {LAB} SELECT visit_id, label, dense_rank() OVER (ORDER BY label) AS target FROM lab WHERE label IS NOT NULL",
)
def _(spark, sf):
    known = labelled(spark, sf).filter(F.col("label").isNotNull())
    return labels.with_dense_target(known).select("visit_id", "label", F.col("target").cast("long").alias("target"))


@query(
    "b13_one_hot",
    f"WITH {V}, {LAB} SELECT visit_id, " + ", ".join(f"(label = '{k}')::INT AS \"is_{k}\"" for k in TRANSITIONS) + " FROM lab",
)
def _(spark, sf):
    out = labels.one_hot(labelled(spark, sf), TRANSITIONS)
    return out.select("visit_id", *[f"is_{k}" for k in TRANSITIONS])


@query("b14_season", f"WITH {V} SELECT visit_id, (month(visit_date) % 12 // 3 + 1)::INT AS season FROM v")
def _(spark, sf):
    return visits(spark, sf).select("visit_id", labels.season(F.col("visit_date")).alias("season"))


@query(
    "b15_day_or_night",
    f"WITH {S} SELECT event_id, CASE WHEN hour(ts) BETWEEN 6 AND 18 THEN 'Day' ELSE 'Night' END AS tag FROM s",
)
def _(spark, sf):
    return series(spark, sf).select("event_id", labels.day_or_night(F.col("ts")).alias("tag"))


# fixed values: sun times of the query in seconds of the day
SUN = (5 * 3600, 7 * 3600, 17 * 3600, 20 * 3600)
SOD = "(epoch_us(ts) // 1000000) % 86400"
PHASE = (
    f"CASE ({SOD} >= {SUN[1]} AND {SOD} < {SUN[2]})::INT + ({SOD} >= {SUN[0]} AND {SOD} < {SUN[3]})::INT"
    " WHEN 2 THEN 'day' WHEN 1 THEN 'transit' ELSE 'night' END"
)


@query("b16_light_phase", f"WITH {S} SELECT event_id, {PHASE} AS phase FROM s")
def _(spark, sf):
    sod = F.pmod(F.unix_seconds("ts"), F.lit(86400))
    return series(spark, sf).select("event_id", labels.light_phase(sod, *[F.lit(x) for x in SUN]).alias("phase"))


# -- joins -------------------------------------------------------------------

SPAN = "sp AS (SELECT series_id, visit_id, score, date_trunc('hour', visit_ts) AS stop, date_trunc('hour', visit_ts) - INTERVAL 7 DAY AS start FROM ve)"


@query(
    "c1_interval_join",
    f"WITH {S}, {VE}, {SPAN} SELECT visit_id, event_id, {q6('value')} AS value FROM s JOIN sp ON s.series_id = sp.series_id"
    " AND ts > start AND ts <= stop",
)
def _(spark, sf):
    spans = samples.visit_spans(visits_on_series(spark, sf), "1 hour", 7)
    out = joins.interval_join(series(spark, sf), spans)
    return out.select("visit_id", "event_id", r6("value").alias("value"))


@query(
    "c2_match_short_ids",
    "SELECT s_suppkey, c_custkey, c_name FROM supplier LEFT JOIN customer ON c_custkey % 1000 = s_suppkey",
)
def _(spark, sf):
    full = table(spark, sf, "customer")
    tags = table(spark, sf, "supplier").select("s_suppkey")
    out = joins.match_short_ids(tags, full, digits=3, tag="s_suppkey", full_id="c_custkey")
    return out.join(full.select("c_custkey", "c_name"), "c_custkey", "left").select("s_suppkey", "c_custkey", "c_name")


@query(
    "c2_unmatched_tags",
    "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT c_custkey % 1000 FROM customer)",
)
def _(spark, sf):
    tags = table(spark, sf, "part").select("p_partkey")
    return joins.unmatched_tags(tags, table(spark, sf, "customer"), digits=3, tag="p_partkey", full_id="c_custkey")


@query(
    "c3_remap_ids",
    "SELECT (c_custkey * 10 + c_nationkey)::BIGINT AS series_id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey"
    " WHERE c_acctbal >= 0 GROUP BY 1",
)
def _(spark, sf):
    c = table(spark, sf, "customer").filter(F.col("c_acctbal") >= 0)
    mapping = c.select(
        F.col("c_custkey").alias("old_id"), (F.col("c_custkey") * 10 + F.col("c_nationkey")).cast("long").alias("new_id")
    )
    out = joins.remap_ids(visits(spark, sf), mapping, key="series_id")
    return out.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c4_same_day_value",
    f"WITH {V}, w AS (SELECT o_custkey AS series_id, o_orderdate::DATE AS visit_date, max(o_totalprice) AS kg FROM orders"
    f" WHERE o_orderstatus = 'F' GROUP BY 1, 2) SELECT visit_id, {q6('kg')} AS kg FROM v LEFT JOIN w USING (series_id, visit_date)",
)
def _(spark, sf):
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    kg = o.groupBy(F.col("o_custkey").alias("series_id"), F.to_date("o_orderdate").alias("visit_date")).agg(
        F.max("o_totalprice").alias("kg")
    )
    return joins.same_day_value(visits(spark, sf), kg, "kg").select("visit_id", r6("kg").alias("kg"))


@query(
    "c5_hourly_lookup",
    f"WITH {S}, {WX} SELECT event_id, {q6('temp_c')} AS temp_c, {q6('humidity')} AS humidity FROM s LEFT JOIN wx"
    " ON wx.hour = date_trunc('hour', s.ts)",
)
def _(spark, sf):
    out = joins.hourly_lookup(series(spark, sf), weather(spark, sf), ["temp_c", "humidity"])
    return out.select("event_id", r6("temp_c").alias("temp_c"), r6("humidity").alias("humidity"))


def _exo_sql(offset, order):
    return (
        f"WITH {VE}, {WX}, days AS (SELECT DISTINCT hour::DATE AS day FROM wx), hh AS (SELECT unnest(range(0, 24))::INT AS h),"
        " near AS (SELECT day, h, arg_min(temp_c, abs(hour(hour) - h) * 100 + hour(hour)) AS t FROM days, hh"
        " JOIN wx ON wx.hour::DATE = day GROUP BY 1, 2), ago AS (SELECT unnest(range(0, 3))::INT AS a),"
        f" want AS (SELECT visit_id, a, h, (visit_ts::DATE - (a + {offset})::INT)::DATE AS day FROM ve, ago, hh)"
        f" SELECT visit_id, (row_number() OVER (PARTITION BY visit_id ORDER BY {order}, h) - 1)::INT AS pos, {q6('t')} AS x"
        " FROM want LEFT JOIN near USING (day, h)"
    )


def _exo(spark, sf, **kw):
    v = visits_on_series(spark, sf).withColumn("visit_date", F.to_date("visit_ts"))
    out = joins.exogenous_window(v, weather(spark, sf), 3, column="temp_c", **kw)
    return out.select("visit_id", F.posexplode("temp_c").alias("pos", "x")).withColumn("x", r6("x"))


@query("c6_exogenous_window", _exo_sql(0, "a DESC"))
def _(spark, sf):
    return _exo(spark, sf)


@query("c6_exogenous_window_shifted", _exo_sql(3, "a"))
def _(spark, sf):
    return _exo(spark, sf, offset_days=3, descending=True)


@query(
    "c7_attach_points",
    f"WITH {HOURLY}, a AS (SELECT user_id AS series_id, date_trunc('hour', ts) AS ts, max(1 + event_id % 5)::INT AS score,"
    " min(value) AS kg FROM events WHERE event_type = 'signup' GROUP BY 1, 2), c AS (SELECT user_id AS series_id,"
    " date_trunc('hour', ts) AS ts, max(value) AS cs FROM events WHERE event_type = 'error' GROUP BY 1, 2)"
    f" SELECT series_id, pos, score, {q6('kg')} AS kg, {q6('cs')} AS cs FROM g LEFT JOIN a USING (series_id, ts)"
    " LEFT JOIN c USING (series_id, ts)",
)
def _(spark, sf):
    s = series(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    up = s.filter(F.col("kind") == "signup").groupBy("series_id", "ts").agg(
        F.max((1 + F.col("event_id") % 5).cast("int")).alias("score"), F.min("value").alias("kg")
    )
    err = s.filter(F.col("kind") == "error").groupBy("series_id", "ts").agg(F.max("value").alias("cs"))
    out = joins.attach_points(hourly_grid(spark, sf), {"score": up, "kg": up, "cs": err})
    return out.select("series_id", "pos", "score", r6("kg").alias("kg"), r6("cs").alias("cs"))


WEEKLY = "wk AS (SELECT user_id AS series_id, date_trunc('week', ts)::DATE AS day, sum(value) AS value FROM events GROUP BY 1, 2)"
DAILY = WEEKLY.replace("'week'", "'day'").replace("wk AS", "dy AS")
VD = "vd AS (SELECT series_id, visit_id, visit_ts::DATE AS visit_date, score FROM ve)"


def bucketed(spark, sf, unit):
    return series(spark, sf).groupBy("series_id", F.to_date(F.date_trunc(unit, "ts")).alias("day")).agg(F.sum("value").alias("value"))


def dated(spark, sf):
    return visits_on_series(spark, sf).withColumn("visit_date", F.to_date("visit_ts"))


@query(
    "c8_tolerance_join",
    f"WITH {VE}, {VD}, {WEEKLY} SELECT series_id, {qday('day')} AS day, {q6('any_value(value)')} AS value,"
    " arg_max(score, visit_date::VARCHAR || lpad(visit_id::VARCHAR, 12, '0')) AS score FROM wk LEFT JOIN vd USING (series_id)"
    " WHERE visit_date IS NULL OR abs(visit_date - day) <= 5 GROUP BY 1, day"
    f" UNION ALL SELECT series_id, {qday('day')}, {q6('value')}, NULL FROM wk WHERE NOT EXISTS (SELECT 1 FROM vd"
    " WHERE vd.series_id = wk.series_id AND abs(visit_date - day) <= 5) AND EXISTS (SELECT 1 FROM vd WHERE vd.series_id = wk.series_id)",
)
def _(spark, sf):
    out = joins.tolerance_join(bucketed(spark, sf, "week"), dated(spark, sf), 5)
    return out.select("series_id", day_text("day").alias("day"), r6("value").alias("value"), "score")


@query(
    "c9_day_join",
    f"WITH {VE}, {VD}, {DAILY}, o AS (SELECT series_id, visit_date AS day, arg_max(score, visit_id) AS score FROM vd GROUP BY 1, 2)"
    f" SELECT series_id, {qday('day')} AS day, {q6('value')} AS value, score FROM dy LEFT JOIN o USING (series_id, day)",
)
def _(spark, sf):
    out = joins.day_join(bucketed(spark, sf, "day"), dated(spark, sf))
    return out.select("series_id", day_text("day").alias("day"), r6("value").alias("value"), "score")


@query(
    "c10_event_at_time",
    f"WITH {S}, {VE}, sp AS (SELECT series_id, visit_id, score, visit_ts AS stop, visit_ts - INTERVAL 1 DAY AS start FROM ve),"
    " hit AS (SELECT event_id, arg_max(score, epoch_us(stop)) AS score FROM s JOIN sp ON s.series_id = sp.series_id AND"
    " ts >= start AND ts <= stop GROUP BY 1) SELECT event_id, coalesce(score, -1) AS score FROM s LEFT JOIN hit USING (event_id)",
)
def _(spark, sf):
    v = visits_on_series(spark, sf)
    spans = v.withColumns({"stop": F.col("visit_ts"), "start": F.col("visit_ts") - F.expr("INTERVAL 1 DAY")})
    out = joins.event_at(series(spark, sf), spans, "score", key=["event_id"], tie="visit_id")
    return out.select("event_id", "score")


@query(
    "c11_align_samples",
    f"WITH {V}, {LAB}, a AS (SELECT * FROM lab), b AS (SELECT series_id, visit_date, label FROM"
    " lab WHERE score > 1), c AS (SELECT series_id, visit_date, label FROM lab WHERE prev1 < 5) SELECT visit_id FROM a WHERE"
    " (series_id, visit_date, label) IN (SELECT * FROM b) AND (series_id, visit_date, label) IN (SELECT * FROM c)",
)
def _(spark, sf):
    v = labelled(spark, sf)
    others = [v.filter(F.col("score") > 1), v.filter(F.col("prev1") < 5)]
    return joins.align_samples(v, others, ["series_id", "visit_date", "label"]).select("visit_id")


@query(
    "c12_blank_test_windows",
    f"WITH {HOURLY}, {VE}, sp AS (SELECT series_id, visit_ts AS stop, visit_ts - INTERVAL 2 DAY AS start FROM ve WHERE score = 1)"
    f" SELECT series_id, pos, CASE WHEN EXISTS (SELECT 1 FROM sp WHERE sp.series_id = g.series_id AND ts > start AND ts <= stop)"
    f" THEN NULL ELSE {q6('value')} END AS value FROM g",
)
def _(spark, sf):
    v = visits_on_series(spark, sf).filter(F.col("score") == 1)
    spans = v.withColumns({"stop": F.col("visit_ts"), "start": F.col("visit_ts") - F.expr("INTERVAL 2 DAYS")})
    out = joins.blank_inside(hourly_grid(spark, sf), spans)
    return out.select("series_id", "pos", r6("value").alias("value"))


HERD = "herd AS (SELECT ts, avg(value) AS mean, median(value) AS median FROM g GROUP BY 1)"


@query(
    "c14_reference_trace",
    f"WITH {COMMON}, {HERD}, {VE}, {SPAN} SELECT visit_id, (date_diff('hour', start, g.ts) - 1)::BIGINT AS pos, {q6('value')} AS value,"
    f" {q6('mean')} AS mean, {q6('median')} AS median FROM g JOIN sp ON g.series_id = sp.series_id AND g.ts > start AND g.ts <= stop"
    " JOIN herd ON herd.ts = g.ts",
)
def _(spark, sf):
    from tracelab.operators.herd import herd_series

    trace = common_hourly(spark, sf)
    cells = samples.sample_cells(trace, visits_on_series(spark, sf), "1 hour", 7)
    # written out, so that Spark knows how small it is before the cells of all windows, of which there are far more, are dealt out for the join
    out = cells.join(materialise(herd_series(trace), "herd"), "ts")
    return out.select("visit_id", "pos", *[r6(c).alias(c) for c in ("value", "mean", "median")])


@query(
    "c15_markup_matrix",
    f"WITH {HOURLY}, {VE}, mk AS (SELECT ve.series_id, date_diff('hour', lo, date_trunc('hour', visit_ts)) AS mpos, max(score) AS mark"
    " FROM ve JOIN b ON ve.series_id = b.series_id GROUP BY 1, 2) SELECT g.series_id, g.pos, arg_max(mark, mpos) AS mark FROM g"
    " LEFT JOIN mk ON mk.series_id = g.series_id AND g.pos BETWEEN mpos - 48 AND mpos - 1 GROUP BY 1, 2",
)
def _(spark, sf):
    g = hourly_grid(spark, sf)
    hours = visits_on_series(spark, sf).withColumn("ts", F.date_trunc("hour", "visit_ts"))
    marks = hours.groupBy("series_id", "ts").agg(F.max("score").alias("mark"))
    placed = marks.join(g.select("series_id", "ts", "pos"), ["series_id", "ts"]).select("series_id", "pos", "mark")
    return joins.mark_before(g.select("series_id", "pos"), placed, 48)


@query(
    "c16_outer_join_traces",
    "WITH a AS (SELECT date_trunc('hour', ts) AS ts, sum(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1),"
    " b AS (SELECT date_trunc('hour', ts) AS ts, sum(value) AS v FROM events WHERE event_type = 'error' GROUP BY 1)"
    f" SELECT {qsecs('coalesce(a.ts, b.ts)')} AS ts_s, {q6('a.v')} AS click, {q6('b.v')} AS error FROM a FULL JOIN b ON a.ts = b.ts",
)
def _(spark, sf):
    s = series(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    one = {k: s.filter(F.col("kind") == k).groupBy("ts").agg(F.sum("value").alias("value")) for k in ("click", "error")}
    out = joins.outer_join_traces(one["click"], one["error"], ("click", "error"))
    return out.select(secs("ts").alias("ts_s"), r6("click").alias("click"), r6("error").alias("error"))


_WIDE = (
    "WITH h AS (SELECT user_id AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS v FROM events GROUP BY 1, 2),"
    " ids AS (SELECT series_id, (row_number() OVER (ORDER BY series_id) - 1) // 64 AS block, (row_number() OVER (ORDER BY series_id) - 1) % 64 AS slot FROM (SELECT DISTINCT series_id FROM h))"
)


@query(
    "c16_wide_herd_table",
    f"{_WIDE}, seen AS (SELECT DISTINCT h.ts, block FROM h JOIN ids USING (series_id) WHERE v IS NOT NULL)"
    f" SELECT {qsecs('seen.ts')} AS ts_s, seen.block::BIGINT AS block, count(v) AS seen, string_agg(coalesce(floor(v * 100 + 0.5)::BIGINT::VARCHAR, ''), ',' ORDER BY slot) AS cents"
    " FROM seen JOIN ids ON ids.block = seen.block LEFT JOIN h ON h.series_id = ids.series_id AND h.ts = seen.ts GROUP BY seen.ts, seen.block",
)
def _(spark, sf):
    wide, _ = joins.wide_traces(grid.bucket_sum(series(spark, sf), "1 hour"), width=64)
    seen = F.size(F.filter("values", lambda v: v.isNotNull())).cast("long")
    cents = F.array_join(F.transform("values", lambda v: F.coalesce(F.floor(v * 100 + 0.5).cast("string"), F.lit(""))), ",")
    return wide.select(secs("ts").alias("ts_s"), "block", seen.alias("seen"), cents.alias("cents"))


@query(
    "c16_silent_hours",
    "WITH h AS (SELECT date_trunc('hour', ts) AS ts, count(value) AS n FROM events GROUP BY 1), e AS (SELECT date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) + INTERVAL 1 DAY AS hi FROM h),"
    f" g AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM e) SELECT {qsecs('g.ts')} AS ts_s FROM g LEFT JOIN h USING (ts) WHERE coalesce(n, 0) = 0",
)
def _(spark, sf):
    hourly = grid.bucket_sum(series(spark, sf), "1 hour")
    wide, _ = joins.wide_traces(hourly, width=64)
    times = grid.common_grid(hourly.select("ts").distinct().withColumn("herd", F.lit(0)), "1 hour", series="herd").select("ts")
    return joins.silent_times(wide, times).select(secs("ts").alias("ts_s"))


@query(
    "c16_quiet_stretches_dropped",
    f"WITH {HOURLY}, u AS (SELECT lo0 + INTERVAL 1 HOUR * i AS ts, i AS pos FROM (SELECT min(lo) AS lo0, unnest(range(0,"
    " date_diff('hour', min(lo), max(hi)) + 1)) AS i FROM b)), t AS (SELECT u.ts, u.pos, count(value) AS seen FROM u LEFT JOIN h"
    " ON h.ts = u.ts GROUP BY 1, 2), m AS (SELECT *, pos - row_number() OVER (PARTITION BY seen = 0 ORDER BY pos) AS k FROM t),"
    " r AS (SELECT *, count(*) OVER (PARTITION BY seen = 0, k) AS len FROM m)"
    f" SELECT {qsecs('ts')} AS ts_s, seen FROM r WHERE NOT (seen = 0 AND len > 2)",
)
def _(spark, sf):
    from tracelab.operators.herd import drop_quiet_stretches

    out = drop_quiet_stretches(grid.bucket_sum(series(spark, sf), "1 hour"), "1 hour", 2)
    return out.select(secs("ts").alias("ts_s"), "seen")


@query(
    "c17_herd_context",
    f"WITH {S}, {VE} SELECT visit_id AS sample_id, series_id, count(*) AS n, {q6('sum(value)')} AS total FROM"
    " (SELECT visit_id, visit_ts FROM ve) v JOIN s ON ts > visit_ts - INTERVAL 1 DAY AND ts <= visit_ts GROUP BY 1, 2",
)
def _(spark, sf):
    v = visits_on_series(spark, sf).select(F.col("visit_id").alias("sample_id"), F.col("visit_ts").alias("stop"))
    out = joins.herd_window_sums(series(spark, sf), v, 1)
    return out.select("sample_id", "series_id", "n", r6("total").alias("total"))


@query(
    "c17_herd_context_week",
    f"WITH {S}, {VE} SELECT visit_id AS sample_id, series_id, count(*) AS n, {q6('sum(value)')} AS total FROM"
    " (SELECT visit_id, visit_ts FROM ve) v JOIN s ON ts > visit_ts - INTERVAL 7 DAY AND ts <= visit_ts GROUP BY 1, 2",
)
def _(spark, sf):
    v = visits_on_series(spark, sf).select(F.col("visit_id").alias("sample_id"), F.col("visit_ts").alias("stop"))
    out = joins.herd_window_sums(series(spark, sf), v, 7)
    return out.select("sample_id", "series_id", "n", r6("total").alias("total"))


# -- labelled samples --------------------------------------------------------

FLAGGED = COMMON.replace("\ng AS (", "\ng0 AS (") + (
    ",\ng AS (SELECT series_id, ts, pos, value, CASE WHEN value IS NULL OR dayofmonth(ts) % 3 = 0 THEN 1 ELSE 0 END AS imputed FROM g0)"
)


def flagged_trace(spark, sf):
    """Hourly herd grid whose empty cells, and every third day, carry the imputed flag."""
    g = common_hourly(spark, sf)
    flag = F.when(F.col("value").isNull() | (F.dayofmonth("ts") % 3 == 0), 1).otherwise(0)
    return g.withColumn("imputed", flag)


CELLS = (
    f"{VE}, {SPAN}, cell AS (SELECT visit_id, g.series_id, g.ts, (date_diff('hour', start, g.ts) - 1)::BIGINT AS pos, value, imputed"
    " FROM g JOIN sp ON g.series_id = sp.series_id AND g.ts > start AND g.ts <= stop)"
)
VLAB = (
    "vl AS (SELECT *, lag(score) OVER (PARTITION BY series_id ORDER BY visit_ts, visit_id) AS prev_score FROM ve),\n"
    "dayf AS (SELECT visit_id, pos // 24 AS d, min(imputed) AS i, count(value) AS c, count(*) AS n FROM cell GROUP BY 1, 2),\n"
    "flag AS (SELECT visit_id, count(*) FILTER (i = 1 AND n = 24) AS imputed_days, count(*) FILTER (c = 24 AND n = 24) AS complete_days"
    " FROM dayf GROUP BY 1)"
)


@query(
    "t14_imputed_day_flags",
    f"WITH {FLAGGED}, {CELLS}, {VLAB} SELECT visit_id AS sample_id, imputed_days, complete_days FROM flag",
)
def _(spark, sf):
    from tracelab.operators.impute import sample_day_flags

    cells = samples.sample_cells(flagged_trace(spark, sf), visits_on_series(spark, sf), "1 hour", 7)
    return sample_day_flags(cells.withColumnRenamed("visit_id", "sample_id"), 24)


@query(
    "b20_sample_validity",
    f"WITH {FLAGGED}, {CELLS}, {VLAB}, b AS (SELECT visit_id, count(*) AS length, count(*) - count(value) AS nulls FROM cell GROUP BY 1),"
    " r AS (SELECT visit_id, coalesce(length, 0) AS length, CASE WHEN coalesce(length, 0) != 168 THEN 'length' WHEN nulls > 0 THEN"
    " 'null cells' WHEN score IS NULL THEN 'no score' WHEN prev_score IS NULL THEN 'no previous score' END AS reason FROM vl"
    " LEFT JOIN b USING (visit_id)) SELECT visit_id, length, reason, (reason IS NULL)::INT AS is_valid FROM r",
)
def _(spark, sf):
    v = visits_on_series(spark, sf)
    cells = samples.sample_cells(flagged_trace(spark, sf), v, "1 hour", 7)
    out = samples.sample_report(cells, v, 168)
    return out.select("visit_id", "length", "reason", F.col("is_valid").cast("int").alias("is_valid"))


M1_SQL = (
    f"WITH {FLAGGED}, {CELLS}, {VLAB}, b AS (SELECT visit_id, count(*) AS cells, count(value) AS seen, string_agg(coalesce("
    "(floor(value * 100 + 0.5::DOUBLE))::BIGINT::VARCHAR, '_'), ',' ORDER BY pos) AS body FROM cell GROUP BY 1)"
    " SELECT visit_id AS sample_id, vl.series_id, prev_score || 'To' || score AS label, imputed_days, complete_days, cells, seen,"
    " (imputed_days >= 1 AND seen > 0)::INT AS valid, body FROM vl JOIN b USING (visit_id) JOIN flag USING (visit_id)"
    " WHERE prev_score IS NOT NULL AND cells = 168"
)


@query("m1_labelled_samples", M1_SQL)
def labelled_samples(spark, sf):
    out = samples.labelled_samples(flagged_trace(spark, sf), visits_on_series(spark, sf), "1 hour", 7)
    text = F.transform("features", lambda x: F.coalesce(F.floor(x * 100 + 0.5).cast("string"), F.lit("_")))
    return out.select(
        "sample_id", "series_id", "label", "imputed_days", "complete_days", "cells", "seen",
        F.col("valid").cast("int").alias("valid"), F.array_join(text, ",").alias("body"),
    )


@query(
    "m5_drop_synthetic_samples",
    f"WITH {FLAGGED}, {CELLS}, {VLAB} SELECT vl.visit_id AS sample_id, CASE WHEN score < 3 THEN 'train' ELSE 'test' END AS split,"
    " imputed_days FROM vl JOIN flag USING (visit_id) WHERE NOT (score >= 3 AND imputed_days >= 2)",
)
def _(spark, sf):
    from tracelab.operators.impute import sample_day_flags
    from tracelab.operators.splits import drop_synthetic_test

    v = visits_on_series(spark, sf)
    cells = samples.sample_cells(flagged_trace(spark, sf), v, "1 hour", 7).withColumnRenamed("visit_id", "sample_id")
    flags = sample_day_flags(cells, 24)
    split = F.when(F.col("score") < 3, "train").otherwise("test").alias("split")
    folds = v.select(F.col("visit_id").alias("sample_id"), split).join(flags, "sample_id")
    return drop_synthetic_test(folds, 2).select("sample_id", "split", "imputed_days")


@query(
    "b6_at_most_imputed",
    f"WITH {FLAGGED}, {CELLS}, {VLAB} SELECT vl.visit_id, imputed_days FROM vl LEFT JOIN flag USING (visit_id) WHERE imputed_days <= 1",
)
def _(spark, sf):
    from tracelab.operators.impute import sample_day_flags

    v = visits_on_series(spark, sf)
    cells = samples.sample_cells(flagged_trace(spark, sf), v, "1 hour", 7).withColumnRenamed("visit_id", "sample_id")
    flags = sample_day_flags(cells, 24).withColumnRenamed("sample_id", "visit_id")
    return filters.at_most_imputed(v.join(flags, "visit_id", "left"), 1).select("visit_id", "imputed_days")


@query(
    "i18_expected_length",
    f"WITH {FLAGGED}, {CELLS}, n AS (SELECT visit_id, count(*) AS cells FROM cell GROUP BY 1) SELECT visit_id, cells, (7 * 24 + 1)::INT"
    " AS expected, (cells + 1 = 7 * 24 + 1)::INT AS whole FROM n",
)
def _(spark, sf):
    cells = samples.sample_cells(flagged_trace(spark, sf), visits_on_series(spark, sf), "1 hour", 7)
    n = cells.groupBy("visit_id").agg(F.count(F.lit(1)).alias("cells"))
    expected = samples.expected_length(F.lit("hour"), F.lit(7))
    return n.select("visit_id", "cells", expected.alias("expected"), (F.col("cells") + 1 == expected).cast("int").alias("whole"))


@query(
    "m28_null_rate_by_hour",
    f"WITH {FLAGGED}, {CELLS} SELECT pos // 24 AS day, (pos % 24)::INT AS hour, {q6('avg((value IS NULL)::INT)')} AS null_rate FROM cell GROUP BY 1, 2",
)
def _(spark, sf):
    cells = samples.sample_cells(flagged_trace(spark, sf), visits_on_series(spark, sf), "1 hour", 7)
    day, hour = F.floor(F.col("pos") / 24).alias("day"), F.pmod("pos", F.lit(24)).cast("int").alias("hour")
    return cells.groupBy(day, hour).agg(r6(F.avg(F.col("value").isNull().cast("int"))).alias("null_rate"))
