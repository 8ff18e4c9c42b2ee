"""Queries over samples: cell functions, filters, normalisation and time-frequency features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tracelab.functions import scalar
from tracelab.operators import filters, grid, herd, impute, joins, normalise, runlength, spectral, stats
from tracelab.operators import samples as sm
from tracelab.plans.bindings import HOURLY, S, WX, X, hourly_grid, long_features, q6, r6, samples, secs, series, table, weather
from tracelab.plans.registry import query
from tracelab.plans.trace_queries import COMMON, common_hourly, sparse_hourly
from tracelab.session import materialise

OUT = f"sample_id, pos::INT AS pos, {q6('x')} AS x"

# samples with holes: one position is null everywhere, some samples are null throughout
HX = f"{X}, hx AS (SELECT sample_id, label, pos, CASE WHEN pos = 63 OR sample_id % 17 = 0 OR x < -0.2 THEN NULL ELSE x END AS x FROM x)"


def holed(spark, sf):
    return samples(spark, sf).withColumn(
        "features",
        F.transform("features", lambda x, i: F.when(~((i == 63) | (F.col("sample_id") % 17 == 0) | (x < -0.2)), x)),
    )


# -- scalar functions --------------------------------------------------------

_ANS = "2 * sqrt(greatest(value / 2.0::DOUBLE + 0.375 + 0.5 / 4.0, 0))"


@query(
    "i1_anscombe",
    f"WITH {S} SELECT event_id, {q6('2 * sqrt(greatest(value + 0.375, 0))')} AS plain, {q6(_ANS)} AS general,"
    f" {q6('2 * sqrt(abs(value) + 0.375)')} AS simple FROM s",
)
def _(spark, sf):
    v = F.col("value")
    return series(spark, sf).select(
        "event_id",
        r6(scalar.anscombe(v)).alias("plain"),
        r6(scalar.anscombe(v, sigma_sq=0.5, alpha=2.0)).alias("general"),
        r6(scalar.anscombe_simple(v)).alias("simple"),
    )


_Y = "greatest(2 * sqrt(value + 0.375), 0.8)"


@query(
    "i2_inverse_anscombe",
    f"WITH {S}, y AS (SELECT event_id, 2 * sqrt(value + 0.375) AS y, {_Y} AS t FROM s) SELECT event_id,"
    f" {q6('t * t / 4.0 + 0.25::DOUBLE * sqrt(1.5) / t - 1.375::DOUBLE / (t * t) + 0.625::DOUBLE * sqrt(1.5) / (t * t * t) - 0.125')} AS closed,"
    f" {q6('y * y / 4.0 - 0.125')} AS asym FROM y",
)
def _(spark, sf):
    y = scalar.anscombe(F.col("value"))
    return series(spark, sf).select(
        "event_id",
        r6(scalar.inverse_anscombe(y)).alias("closed"),
        r6(scalar.inverse_anscombe(y, method="asym")).alias("asym"),
    )


@query(
    "i3_logs",
    f"WITH {S} SELECT event_id, {q6('CASE WHEN value - 50 > 0 THEN ln(value - 50) ELSE 0 END')} AS masked,"
    f" {q6('ln(2 * sqrt(abs(value) + 0.375))')} AS log_anscombe FROM s",
)
def _(spark, sf):
    return series(spark, sf).select(
        "event_id",
        r6(scalar.masked_log(F.col("value") - 50)).alias("masked"),
        r6(scalar.log_anscombe(F.col("value"))).alias("log_anscombe"),
    )


@query("i4_root_and_exp", f"WITH {S} SELECT event_id, {q6('sqrt(value)')} AS root, {q6('exp(value / 100)')} AS e FROM s")
def _(spark, sf):
    return series(spark, sf).select("event_id", r6(scalar.root(F.col("value"))).alias("root"), r6(scalar.unlog(F.col("value") / 100)).alias("e"))


@query(
    "i5_magnitude",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,"
    f" {q6('sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax)')} AS low,"
    f" {q6('sqrt(l_quantity * l_quantity * 4 + 1 + l_tax * l_tax)')} AS high FROM lineitem",
)
def _(spark, sf):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        r6(scalar.magnitude(q, d, t)).alias("low"),
        r6(scalar.magnitude(q * 2, F.lit(1.0), t)).alias("high"),
    )


@query(
    "i6_round_to_base",
    f"WITH {S} SELECT event_id, {q6('round_even(value / 5.0::DOUBLE, 0) * 5')} AS nearest, {q6('floor(value / 5.0::DOUBLE) * 5')} AS below,"
    f" {q6('ceil(value / 10.0::DOUBLE) * 10')} AS above FROM s",
)
def _(spark, sf):
    v = F.col("value")
    return series(spark, sf).select(
        "event_id",
        r6(scalar.round_to(v, 5)).alias("nearest"),
        r6(scalar.floor_to(v, 5)).alias("below"),
        r6(scalar.ceil_to(v, 10)).alias("above"),
    )


_SPAN = "sp AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate AS a, TIMESTAMP '2003-03-30 05:06:07' + INTERVAL 1 SECOND * (l_orderkey * 37) AS b FROM lineitem)"


@query(
    "i7_elapsed",
    f"WITH {_SPAN}, m0 AS (SELECT *, ((year(b) - year(a)) * 12 + month(b) - month(a))::INT AS r FROM sp),"
    " m AS (SELECT *, CASE WHEN a + INTERVAL 1 MONTH * r <= b THEN r ELSE r - 1 END AS m FROM m0),"
    " e AS (SELECT *, ((epoch_us(b) - epoch_us(a + INTERVAL 1 MONTH * m)) // 1000000)::BIGINT AS s FROM m)"
    " SELECT l_orderkey, l_linenumber, l_partkey, ceil((epoch_us(b) - epoch_us(a)) / 60000000.0::DOUBLE)::BIGINT AS minutes,"
    " printf('%02d:%02d:%02d:%02d', s // 86400, s % 86400 // 3600, s % 3600 // 60, s % 60) AS short,"
    " printf('%d years %d months %d days %d hours %d minutes %d seconds', m // 12, m % 12, s // 86400, s % 86400 // 3600,"
    " s % 3600 // 60, s % 60) AS long FROM e",
)
def _(spark, sf):
    a = F.col("l_shipdate")
    b = F.timestamp_seconds(F.unix_seconds(F.lit("2003-03-30 05:06:07").cast("timestamp")) + F.col("l_orderkey") * 37)
    d = scalar.calendar_difference(a, b)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        scalar.elapsed_minutes(a, b).alias("minutes"),
        scalar.elapsed_short(d).alias("short"),
        scalar.elapsed_long(d).alias("long"),
    )


@query(
    "i8_same_unit",
    f"WITH {S}, n AS (SELECT event_id, ts, ts + INTERVAL 1 MINUTE * floor(value)::BIGINT AS u FROM s) SELECT event_id,"
    + ", ".join(f" (date_trunc('{u}', ts) = date_trunc('{u}', u))::INT AS same_{u}" for u in ("day", "month", "hour", "minute"))
    + " FROM n",
)
def _(spark, sf):
    later = F.timestamp_micros(F.unix_micros("ts") + F.floor("value") * 60_000_000)
    units = ("day", "month", "hour", "minute")
    return series(spark, sf).select(
        "event_id", *[scalar.same(u, F.col("ts"), later).cast("int").alias(f"same_{u}") for u in units]
    )


@query(
    "i9_time_text",
    f"WITH {S} SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M') AS date_str, strftime(ts, '%d/%m/%Y') AS day_first,"
    " (epoch_us(date_trunc('minute', ts)) // 1000000)::BIGINT AS epoch_s FROM s",
)
def _(spark, sf):
    text = scalar.minute_text(F.col("ts"))
    return series(spark, sf).select(
        "event_id",
        text.alias("date_str"),
        scalar.day_first_text(F.col("ts")).alias("day_first"),
        scalar.epoch_of_minute(text).alias("epoch_s"),
    )


@query(
    "i10_weather_hour",
    f"WITH {S} SELECT event_id, lpad(hour(ts)::VARCHAR, 2, '0') || ':00' AS at FROM s",
)
def _(spark, sf):
    text = (F.hour("ts") * 100).cast("string")
    return series(spark, sf).select("event_id", scalar.weather_hour(text).alias("at"))


_AXES = "a AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '1:2' ELSE concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::INT, -1) END AS t FROM lineitem)"


@query(
    "i11_parse_axes",
    f"WITH {_AXES} SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(
        f"CASE WHEN len(string_split(t, ':')) = 6 THEN split_part(t, ':', {i})::INT END AS {n}"
        for i, n in enumerate(("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"), 1)
    )
    + " FROM a",
)
def _(spark, sf):
    full = F.concat_ws(
        ":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
        F.col("l_quantity").cast("int").cast("string"), F.lit("-1"),
    )
    kind = F.col("l_linenumber") % 3
    text = F.when(kind == 0, "").when(kind == 1, "1:2").otherwise(full)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalar.parse_axes(text).alias("a")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "a.*"
    )


_DIRTY = (
    "d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '-' || event_id || '@' WHEN 1 THEN lower(to_hex(event_id)) WHEN 2 THEN ''"
    " ELSE event_id || '.0' END AS t FROM events)"
)


@query(
    "i12_tolerant_integers",
    f"WITH {_DIRTY} SELECT event_id, CASE WHEN regexp_full_match(split_part(replace(t, '@', ''), '.', 1), '-?[0-9]+') THEN split_part(replace(t, '@', ''), '.', 1)::BIGINT ELSE -1 END AS plain,"
    " coalesce(TRY_CAST(regexp_replace(t, '[^0-9]', '', 'g') AS BIGINT), -1) AS digits,"
    " CASE WHEN regexp_full_match(split_part(t, '.', 1), '[0-9a-fA-F]+') THEN ('0x' || split_part(t, '.', 1))::BIGINT ELSE -1 END AS hex FROM d",
)
def _(spark, sf):
    e = F.col("event_id")
    t = (
        F.when(e % 4 == 0, F.concat(F.lit("-"), e.cast("string"), F.lit("@")))
        .when(e % 4 == 1, F.lower(F.hex(e)))
        .when(e % 4 == 2, F.lit(""))
        .otherwise(F.concat(e.cast("string"), F.lit(".0")))
    )
    return series(spark, sf).select(
        "event_id",
        scalar.tolerant_int(t).alias("plain"),
        scalar.digits_only(t).alias("digits"),
        scalar.tolerant_hex(t).alias("hex"),
    )


@query(
    "i13_header_names",
    "SELECT user_id AS serialnumber, count(*) AS batterylife, max(event_id) AS datetime FROM events GROUP BY 1",
)
def _(spark, sf):
    raw = table(spark, sf, "events").groupBy(F.col("user_id").alias(" Serial Number")).agg(
        F.count(F.lit(1)).alias("BATTERY IFE"), F.max("event_id").alias("Date Time ")
    )
    return scalar.normalise_headers(raw)


@query(
    "i14_clean_text",
    "SELECT c_custkey, split_part(replace('''' || c_name || '.0''', '''', ''), '.', 1) AS name, right(c_name, 3) AS last3 FROM customer",
)
def _(spark, sf):
    raw = F.concat(F.lit("'"), F.col("c_name"), F.lit(".0'"))
    return table(spark, sf, "customer").select(
        "c_custkey", scalar.clean_id(raw).alias("name"), F.right("c_name", F.lit(3)).alias("last3")
    )


@query(
    "i15_farm_name",
    "SELECT c_custkey, CASE c_nationkey WHEN 3 THEN 'north_3' WHEN 7 THEN 'south_7' ELSE c_nationkey::VARCHAR END AS farm FROM customer",
)
def _(spark, sf):
    names = {"3": "north", "7": "south"}
    return table(spark, sf, "customer").select("c_custkey", scalar.farm_name(F.col("c_nationkey"), names).alias("farm"))


@query(
    "i19_array_functions",
    f"WITH {X}, c AS (SELECT sample_id, pos // 10 AS chunk, sum(x) AS total, count(*) AS n FROM x GROUP BY 1, 2), t AS (SELECT sample_id,"
    " string_agg(pos::VARCHAR, ',' ORDER BY x DESC, pos DESC) AS top FROM (SELECT *, row_number() OVER (PARTITION BY sample_id"
    " ORDER BY x DESC, pos DESC) AS rn FROM x) WHERE rn <= 3 GROUP BY 1)"
    f" SELECT sample_id, chunk::INT AS chunk, n, {q6('total')} AS total, top FROM c JOIN t USING (sample_id)",
)
def _(spark, sf):
    cut = samples(spark, sf).select(
        "sample_id",
        F.array_join(scalar.top_positions(F.col("features"), 3), ",").alias("top"),
        F.posexplode(scalar.chunks(F.col("features"), 10)).alias("chunk", "piece"),
    )
    return cut.select(
        "sample_id", "chunk", F.size("piece").cast("long").alias("n"), r6(normalise.array_sum(F.col("piece"))).alias("total"), "top"
    )


@query(
    "i19_explode_together",
    "SELECT vec_id AS sample_id, i::INT AS i, floor(embedding[i]::DOUBLE * 100)::BIGINT AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
)
def _(spark, sf):
    two = samples(spark, sf).select(
        "sample_id",
        F.transform("features", lambda x, i: (i + 1).cast("int")).alias("i"),
        F.transform("features", lambda x: F.floor(x * 100)).alias("v"),
    )
    return scalar.explode_together(two, ["i", "v"])


@query(
    "i20_list_text",
    "SELECT event_id, 3::INT AS n, " + q6("value + event_id / 4.0::DOUBLE - 0.5") + " AS total FROM events",
)
def _(spark, sf):
    text = F.concat(
        F.lit("["), F.col("value").cast("string"), F.lit(" "), (F.col("event_id") / 4).cast("string"), F.lit("  -0.5]")
    )
    arr = scalar.parse_list(text)
    return series(spark, sf).select(
        "event_id", F.size(arr).alias("n"), r6(normalise.array_sum(arr)).alias("total")
    )


@query(
    "i22_path_columns",
    "SELECT page_id, string_split(url, '/')[3] AS host, string_split(url, '/')[-2] AS lang,"
    " split_part(split_part(string_split(url, '/')[-1], '?', 1), '#', 1) AS name FROM pages",
)
def _(spark, sf):
    u = F.col("url")
    name = F.split_part(F.split_part(scalar.path_part(u, 1), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return table(spark, sf, "pages").select(
        "page_id", F.split_part(u, F.lit("/"), F.lit(3)).alias("host"), scalar.path_part(u, 2).alias("lang"), name.alias("name")
    )


# -- sample filters ----------------------------------------------------------


@query(
    "b7_varied_samples",
    f"WITH {X}, n AS (SELECT sample_id, count(DISTINCT floor(abs(x) * 40)) AS kinds FROM x GROUP BY 1) SELECT sample_id FROM n WHERE kinds > 10",
)
def _(spark, sf):
    coarse = samples(spark, sf).withColumn("features", F.transform("features", lambda x: F.floor(F.abs(x) * 40)))
    return filters.varied(coarse, 10).select("sample_id")


@query("b8_drop_all_null", f"WITH {HX} SELECT sample_id FROM hx GROUP BY 1 HAVING count(x) > 0")
def _(spark, sf):
    return filters.not_all_null(holed(spark, sf)).select("sample_id")


@query("b8_drop_any_null", f"WITH {HX} SELECT sample_id FROM hx WHERE pos < 63 GROUP BY 1 HAVING count(x) = count(*)")
def _(spark, sf):
    cut = holed(spark, sf).withColumn("features", F.slice("features", 1, 63))
    return filters.no_nulls(cut).select("sample_id")


@query("b9_clip_negative", f"WITH {X} SELECT sample_id, pos, {q6('greatest(x, 0)')} AS x FROM x")
def _(spark, sf):
    return long_features(samples(spark, sf).withColumn("features", filters.clip_negative()))


@query("b10_only_classes", "SELECT vec_id AS sample_id, label FROM embeddings WHERE label IN (0, 1)")
def _(spark, sf):
    return filters.only_classes(samples(spark, sf), [0, 1], "label").select("sample_id", "label")


@query(
    "b21_select_and_append",
    f"WITH {X} SELECT {OUT} FROM (SELECT sample_id, pos, x FROM x UNION ALL SELECT sample_id, 64, label * 1.5 FROM x WHERE pos = 0"
    " UNION ALL SELECT sample_id, 65, sample_id FROM x WHERE pos = 0)",
)
def _(spark, sf):
    extra = [F.col("label") * 1.5, F.col("sample_id")]
    return long_features(samples(spark, sf).withColumn("features", filters.append_features(extra)))


@query("b22_drop_empty_positions", f"WITH {HX} SELECT {OUT} FROM hx WHERE pos < 63")
def _(spark, sf):
    return long_features(filters.drop_empty_positions(holed(spark, sf)))


@query("b23_fill_null", f"WITH {HX} SELECT {OUT} FROM (SELECT sample_id, pos, coalesce(x, -1) AS x FROM hx)")
def _(spark, sf):
    return long_features(holed(spark, sf).withColumn("features", filters.fill_null(-1.0)))


# -- slicing and differences -------------------------------------------------


@query("a11_recent_days", f"WITH {X} SELECT d, {OUT.replace('pos::INT', '(pos - (64 - 8 * d))::INT')} FROM x, (SELECT unnest(range(1, 8))::INT AS d) WHERE pos >= 64 - 8 * d")
def _(spark, sf):
    x = samples(spark, sf)
    parts = [long_features(sm.recent_days(x, d, 8)).withColumn("d", F.lit(d)) for d in range(1, 8)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("e11_day_difference", f"WITH {X} SELECT {OUT.replace('pos::INT', '(pos - 8)::INT')} FROM (SELECT sample_id, pos, x - lag(x, 8) OVER (PARTITION BY sample_id ORDER BY pos) AS x FROM x) WHERE pos >= 8")
def _(spark, sf):
    return long_features(normalise.day_difference(samples(spark, sf), 8))


@query(
    "e11_day_difference_appended",
    f"WITH {X}, d AS (SELECT sample_id, pos + 56 AS pos, x - lag(x, 8) OVER (PARTITION BY sample_id ORDER BY pos) AS x, pos AS p FROM x)"
    f" SELECT {OUT} FROM (SELECT sample_id, pos, x FROM x UNION ALL SELECT sample_id, pos, x FROM d WHERE p >= 8)",
)
def _(spark, sf):
    return long_features(normalise.day_difference(samples(spark, sf), 8, append=True))


_LASTD = f"{X}, d AS (SELECT a.sample_id, a.pos, a.x - l.x AS x FROM x a JOIN x l ON l.sample_id = a.sample_id AND l.pos = 56 + a.pos % 8 WHERE a.pos < 56)"


@query("e12_last_day_difference", f"WITH {_LASTD} SELECT {OUT} FROM d")
def _(spark, sf):
    return long_features(normalise.last_day_difference(samples(spark, sf), 8))


@query(
    "e12_last_day_difference_appended",
    f"WITH {_LASTD} SELECT {OUT} FROM (SELECT sample_id, pos, x FROM x UNION ALL SELECT sample_id, pos + 64, x FROM d)",
)
def _(spark, sf):
    return long_features(normalise.last_day_difference(samples(spark, sf), 8, append=True))


@query(
    "e14_rolling_windows",
    f"WITH {X}, w AS (SELECT unnest(range(0, 64 - 16 + 1, 6))::INT AS start) SELECT sample_id, start, (pos - start)::INT AS pos,"
    f" {q6('x')} AS x FROM x JOIN w ON pos >= start AND pos < start + 16",
)
def _(spark, sf):
    return long_features(sm.rolling_windows(samples(spark, sf), 16, 6), "start")


@query(
    "e14_series_windows",
    f"WITH {S}, w AS (SELECT series_id, value, unnest(generate_series((epoch_us(ts) // 86400000000) - 6, epoch_us(ts) // 86400000000)) AS d FROM s)"
    f" SELECT series_id, (d * 86400)::BIGINT AS start_s, count(*) AS n, {q6('sum(value)')} AS total FROM w GROUP BY 1, 2",
)
def _(spark, sf):
    out = grid.sliding_sums(series(spark, sf), "7 days", "1 day")
    return out.select("series_id", secs("start").alias("start_s"), "n", r6("total").alias("total"))


@query(
    "e19_pad_sequences",
    f"WITH {X}, p AS (SELECT sample_id, unnest(range(0, 70))::INT AS pos FROM (SELECT DISTINCT sample_id FROM x)) SELECT sample_id, pos,"
    f" {q6('coalesce(x, -1)')} AS x FROM p LEFT JOIN x USING (sample_id, pos)",
)
def _(spark, sf):
    return long_features(samples(spark, sf).withColumn("features", sm.pad_to(70)))


@query("t19_sum_bins", f"WITH {HX} SELECT sample_id, (pos // 5)::INT AS pos, {q6('sum(x)')} AS x FROM hx GROUP BY 1, 2")
def _(spark, sf):
    return long_features(holed(spark, sf).withColumn("features", sm.sum_bins(5)))


@query(
    "m9_jitter",
    f"WITH {X}, sh AS (SELECT unnest([-3, -2, -1, 1, 2, 3])::INT AS shift) SELECT sample_id, shift, (pos - shift - 4)::INT AS pos,"
    f" {q6('x')} AS x FROM x, sh WHERE pos - shift - 4 BETWEEN 0 AND 55",
)
def _(spark, sf):
    return long_features(sm.jitter(samples(spark, sf), 8), "shift")


@query(
    "t9_linear_fill_of_samples",
    f"WITH {HX}, g AS (SELECT sample_id AS series_id, pos, x AS value FROM hx), a AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN pos END)"
    " OVER (PARTITION BY series_id ORDER BY pos) AS lp, min(CASE WHEN value IS NOT NULL THEN pos END) OVER (PARTITION BY series_id"
    " ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np FROM g), ar AS (SELECT a.*, l.value AS lv, n.value AS nv"
    " FROM a LEFT JOIN g l ON l.series_id = a.series_id AND l.pos = lp LEFT JOIN g n ON n.series_id = a.series_id AND n.pos = np)"
    f" SELECT series_id AS sample_id, pos, {q6('coalesce(value, lv + (nv - lv) * (pos - lp) / (np - lp), lv, nv)')} AS x FROM ar",
)
def _(spark, sf):
    cells = holed(spark, sf).select(F.col("sample_id").alias("series_id"), F.posexplode("features").alias("pos", "value"))
    out = impute.linear_fill(cells)
    return out.select(F.col("series_id").alias("sample_id"), "pos", r6("value").alias("x"))


# -- curves and cell statistics ----------------------------------------------


@query(
    "d13_class_curves",
    f"WITH {X} SELECT label, pos, {q6('avg(x)')} AS mean, {q6('median(x)')} AS median FROM x GROUP BY 1, 2",
)
def _(spark, sf):
    out = stats.class_curves(samples(spark, sf), ["label"])
    return out.select("label", "pos", r6("mean").alias("mean"), r6("median").alias("median"))


@query(
    "d14_percent_zero",
    f"WITH {X}, z AS (SELECT sample_id, label, 100.0 * avg((floor(abs(x) * 10) = 0)::INT) AS p FROM x GROUP BY 1, 2) SELECT label,"
    f" count(*) AS samples, {q6('avg(p)')} AS mean_percent, {q6('max(p)')} AS max_percent FROM z GROUP BY 1",
)
def _(spark, sf):
    coarse = samples(spark, sf).withColumn("features", F.transform("features", lambda x: F.floor(F.abs(x) * 10).cast("double")))
    out = stats.percent_zero_by_class(stats.percent_zero(coarse), "label")
    return out.withColumns({"mean_percent": r6("mean_percent"), "max_percent": r6("max_percent")})


@query(
    "f4_top_half_of_weights",
    f"WITH {X}, w AS (SELECT sample_id, pos, x, row_number() OVER (PARTITION BY sample_id ORDER BY x DESC, pos DESC) AS rn FROM x)"
    f" SELECT sample_id, pos, {q6('CASE WHEN rn <= 32 THEN x ELSE 0 END')} AS x FROM w",
)
def _(spark, sf):
    return long_features(stats.keep_top_share(samples(spark, sf), 2))


@query(
    "f4_top_importances",
    f"WITH {X} SELECT pos, {q6('avg(abs(x))')} AS weight FROM x GROUP BY 1 ORDER BY avg(abs(x)) DESC, pos LIMIT 30",
)
def _(spark, sf):
    w = normalise.cells_of(samples(spark, sf)).groupBy("pos").agg(F.avg(F.abs("x")).alias("weight"))
    return stats.top_rows(w, 30, [F.col("weight").desc(), F.col("pos")]).withColumn("weight", r6("weight"))


@query(
    "f5_blank_largest",
    f"WITH {X}, w AS (SELECT sample_id, pos, x, row_number() OVER (PARTITION BY sample_id ORDER BY x DESC, pos DESC) AS rn FROM x)"
    f" SELECT sample_id, pos, CASE WHEN rn > 10 THEN {q6('x')} END AS x FROM w",
)
def _(spark, sf):
    return long_features(stats.blank_largest(samples(spark, sf), 10))


@query(
    "m24_weighted_samples",
    f"WITH {X}, w AS (SELECT pos, avg(abs(x)) AS w FROM x GROUP BY 1), n AS (SELECT pos, (w - (SELECT min(w) FROM w)) / ((SELECT max(w) FROM w)"
    f" - (SELECT min(w) FROM w)) AS w FROM w) SELECT sample_id, pos, {q6('x * w')} AS x FROM x JOIN n USING (pos)",
)
def _(spark, sf):
    x = samples(spark, sf)
    w = normalise.fit_positions(x, {"w": lambda c: F.avg(F.abs(c))})
    return long_features(stats.weight_features(x, stats.scaled_weights(w)))


_PLANE = (
    f"{X}, w AS (SELECT pos, avg(CASE WHEN label < 5 THEN x END) - avg(CASE WHEN label >= 5 THEN x END) AS w FROM x GROUP BY 1),"
    " dist AS (SELECT sample_id, label, abs(sum(w * x) + 0.1) / sqrt(sum(w * w)) AS dist FROM x JOIN w USING (pos) GROUP BY 1, 2)"
)


def _plane(spark, sf):
    x = samples(spark, sf)
    lab = normalise.cells_of(x, "label").groupBy("pos").agg(
        (F.avg(F.when(F.col("label") < 5, F.col("x"))) - F.avg(F.when(F.col("label") >= 5, F.col("x")))).alias("w")
    )
    return stats.distance_to_plane(x, normalise.as_params(lab, ["w"]), 0.1)


@query("m30_distance_to_plane", f"WITH {_PLANE} SELECT sample_id, {q6('dist')} AS dist FROM dist")
def _(spark, sf):
    return _plane(spark, sf).select("sample_id", r6("dist").alias("dist"))


@query(
    "m31_distance_buckets",
    f"WITH {_PLANE}, r AS (SELECT *, row_number() OVER (PARTITION BY label % 2 ORDER BY floor(dist * 1e6), sample_id) AS rn FROM dist),"
    f" b AS (SELECT sample_id, label % 2 AS class, ((rn + 19) // 20)::BIGINT AS bucket, floor(dist * 1e6) / 1e6 AS dist FROM r) SELECT class::INT AS class,"
    f" bucket, pos, {q6('avg(x)')} AS mean, {q6('min(dist)')} AS low, {q6('max(dist)')} AS high FROM b JOIN x USING (sample_id) GROUP BY 1, 2, 3",
)
def _(spark, sf):
    d = _plane(spark, sf).withColumns(
        {"dist": F.floor(F.col("dist") * 1e6) / F.lit(1e6), "class": (F.col("label") % 2).cast("int")}
    )
    out = stats.distance_buckets(d, "class", 20)
    return out.withColumns({c: r6(c) for c in ("mean", "low", "high")})


# -- normalisation -----------------------------------------------------------

QN = (
    "med AS (SELECT pos, CASE WHEN median(x) <= 0 THEN 1 ELSE median(x) END AS m FROM {src} GROUP BY 1),\n"
    "rt AS (SELECT sample_id, median(CASE WHEN x / m > 0 THEN x / m END) AS f FROM x JOIN med USING (pos) GROUP BY 1),\n"
    "qn AS (SELECT sample_id, pos, coalesce(x / CASE WHEN f <= 0 THEN 1 ELSE f END, 0) AS x, m FROM x JOIN rt USING (sample_id) JOIN med USING (pos))"
)
XA = X.replace("embedding[i]::DOUBLE AS x", "greatest(embedding[i]::DOUBLE, 0) AS x")


def counts(spark, sf):
    """Samples with negative cells clipped, the way counts enter the normalisation."""
    return samples(spark, sf).withColumn("features", filters.clip_negative())


@query("n1_quotient", f"WITH {X}, {QN.format(src='x')} SELECT {OUT} FROM qn")
def _(spark, sf):
    return long_features(normalise.quotient(samples(spark, sf)))


@query("n1_quotient_of_counts", f"WITH {XA}, {QN.format(src='x')} SELECT {OUT} FROM qn")
def _(spark, sf):
    return long_features(normalise.quotient(counts(spark, sf)))


@query(
    "n2_peak_filter",
    f"WITH {X} SELECT sample_id, pos, CASE WHEN (pos + 1) // 8 % 2 = 1 AND (pos + 1) % 8 <= 1 THEN {q6('x')} END AS x FROM x",
)
def _(spark, sf):
    return long_features(normalise.peak_filter(samples(spark, sf), 16))


_LNA = "ln(2 * sqrt(greatest({v} + 0.375, 0)))"


@query(
    "n3_quotient_residual",
    f"WITH {XA}, {QN.format(src='x')} SELECT sample_id, pos, {q6(_LNA.format(v='x') + ' - ' + _LNA.format(v='m'))} AS x FROM qn",
)
def _(spark, sf):
    return long_features(normalise.quotient(counts(spark, sf), residual=True))


_NR = (
    f"WITH {COMMON}, hd AS (SELECT ts, median(value) AS herd FROM g GROUP BY 1), c AS (SELECT series_id || '_' || pos // 168 AS sample_id, pos, value, herd"
    " FROM g JOIN hd USING (ts)), r AS (SELECT sample_id, median(DISTINCT CASE WHEN value IS NOT NULL AND value != 0 AND herd IS NOT NULL"
    " THEN herd / value ELSE 0 END) AS f FROM c GROUP BY 1)"
)


def _herd_cells(spark, sf):
    g = materialise(common_hourly(spark, sf), "trace")
    h = herd.herd_series(g).select("ts", F.col("median").alias("herd"))
    week = F.floor(F.col("pos") / 168).cast("string")
    return g.join(h, "ts").withColumn("sample_id", F.concat_ws("_", F.col("series_id").cast("string"), week))


@query(
    "n4_herd_ratio",
    f"{_NR} SELECT sample_id, pos, {q6('CASE WHEN value != 0 AND herd IS NOT NULL THEN value * abs(f) ELSE value END')} AS scaled FROM c JOIN r USING (sample_id)",
)
def _(spark, sf):
    return herd.herd_ratio(_herd_cells(spark, sf)).select("sample_id", "pos", r6("scaled").alias("scaled"))


@query("n4_herd_difference", f"{_NR} SELECT sample_id, pos, {q6('value - herd')} AS difference FROM c")
def _(spark, sf):
    return herd.herd_difference(_herd_cells(spark, sf)).select("sample_id", "pos", r6("difference").alias("difference"))


POS = "ps AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1)"


def _pos_sql(expr):
    return f"WITH {X}, {POS} SELECT sample_id, pos, {q6(expr)} AS x FROM x JOIN ps USING (pos)"


@query("n5_standard_scale", _pos_sql("(x - mean) / CASE WHEN std > 0 THEN std ELSE 1 END"))
def _(spark, sf):
    return long_features(normalise.standard_scale(samples(spark, sf)))


@query("n6_min_max", _pos_sql("(x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END"))
def _(spark, sf):
    return long_features(normalise.min_max(samples(spark, sf)))


@query("n6_min_max_stored", f"WITH {X}, ps AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM x WHERE label < 5 GROUP BY 1) SELECT sample_id, pos, {q6('(x - lo) / (hi - lo + 1e-6)')} AS x FROM x JOIN ps USING (pos)")
def _(spark, sf):
    x = samples(spark, sf)
    return long_features(normalise.min_max(x, normalise.fit_min_max(x.filter(F.col("label") < 5)), eps=1e-6))


@query("n6_min_max_inverse", _pos_sql("x"))
def _(spark, sf):
    x = samples(spark, sf)
    params = normalise.fit_min_max(x)
    return long_features(normalise.inverse_min_max(normalise.min_max(x, params, eps=1e-6), params, eps=1e-6))


@query("n7_l2", f"WITH {X}, nn AS (SELECT sample_id, sqrt(sum(x * x)) AS n FROM x GROUP BY 1) SELECT sample_id, pos, {q6('x / n')} AS x FROM x JOIN nn USING (sample_id)")
def _(spark, sf):
    return long_features(normalise.l2(samples(spark, sf)))


@query("n8_centre", f"WITH {X} SELECT sample_id, pos, {q6('x - (SELECT avg(x) FROM x)')} AS x FROM x")
def _(spark, sf):
    return long_features(normalise.centre(samples(spark, sf)))


@query("n8_centre_samples", f"WITH {X}, a AS (SELECT sample_id, avg(x) AS a, stddev_pop(x) AS s FROM x GROUP BY 1) SELECT sample_id, pos, {q6('(x - a) / s')} AS x FROM x JOIN a USING (sample_id)")
def _(spark, sf):
    return long_features(normalise.centre_samples(samples(spark, sf), by_deviation=True))


@query("n9_step_functions", f"WITH {X} SELECT sample_id, pos, {q6('ln(2 * sqrt(greatest(abs(x) + 0.375, 0)))')} AS x FROM x")
def _(spark, sf):
    x = samples(spark, sf).withColumn("features", F.transform("features", F.abs))
    return long_features(normalise.apply_steps(x, ["ANSCOMBE", "LOG"]))


@query(
    "n10_round_categorical",
    f"WITH {X}, o AS (SELECT sample_id, pos, CASE WHEN pos % 2 = 0 THEN round_even(x * 10, 0) ELSE x END AS x FROM x), k AS (SELECT pos,"
    f" count(DISTINCT x) AS k FROM o GROUP BY 1) SELECT sample_id, pos, {q6('CASE WHEN k < 20 THEN round_even(x.x * 7, 0) ELSE x.x * 7 END')} AS x FROM x JOIN k USING (pos)",
)
def _(spark, sf):
    x = samples(spark, sf)
    original = x.withColumn("features", F.transform("features", lambda v, i: F.when(i % 2 == 0, F.bround(v * 10)).otherwise(v)))
    imputed = x.withColumn("features", F.transform("features", lambda v: v * 7))
    return long_features(normalise.round_categorical(imputed, original))


@query(
    "n11_step_sequence",
    f"WITH {XA}, {QN.format(src='x')}, an AS (SELECT sample_id, pos, 2 * sqrt(greatest(x + 0.375, 0)) AS x FROM qn), ps AS (SELECT pos, avg(x) AS mean,"
    f" stddev_pop(x) AS std FROM an GROUP BY 1) SELECT sample_id, pos, {q6('(x - mean) / CASE WHEN std > 0 THEN std ELSE 1 END')} AS x FROM an JOIN ps USING (pos)",
)
def _(spark, sf):
    return long_features(normalise.apply_steps(counts(spark, sf), ["QN", "ANSCOMBE", "STANDARDSCALER"]))


@query(
    "n11_several_fits",
    f"WITH {X}, a AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std FROM x GROUP BY 1), s AS (SELECT sample_id, pos,"
    " (x - mean) / CASE WHEN std > 0 THEN std ELSE 1 END AS x FROM x JOIN a USING (pos)), c AS (SELECT sample_id, pos, exp(x - (SELECT avg(x) FROM s)) AS x FROM s),"
    " b AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM c GROUP BY 1), m AS (SELECT sample_id, pos, sqrt((x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END) AS x"
    f" FROM c JOIN b USING (pos)) SELECT sample_id, pos, {q6('x - (SELECT avg(x) FROM m)')} AS x FROM m",
)
def _(spark, sf):
    return long_features(normalise.apply_steps(samples(spark, sf), ["STANDARDSCALER", "CENTER", "EXP", "MINMAX", "SQRT", "CENTER"]))


@query(
    "g5_two_branches",
    f"WITH {X}, nn AS (SELECT sample_id, sqrt(sum(x * x)) AS n FROM x GROUP BY 1) SELECT {OUT} FROM (SELECT sample_id, pos, x / n AS x FROM x JOIN nn"
    " USING (sample_id) UNION ALL SELECT sample_id, pos + 64, sqrt(abs(x)) FROM x)",
)
def _(spark, sf):
    x = samples(spark, sf)
    first = normalise.l2(x)
    second = x.withColumn("features", F.transform("features", lambda v: F.sqrt(F.abs(v))))
    return long_features(joins.zip_features(first, second))


@query(
    "c13_zip_features",
    f"WITH {X} SELECT {OUT} FROM (SELECT sample_id, pos, x FROM x UNION ALL SELECT sample_id, pos + 64, x * label FROM x WHERE pos < 10)",
)
def _(spark, sf):
    x = samples(spark, sf)
    more = x.withColumn("features", F.transform(F.slice("features", 1, 10), lambda v: v * F.col("label")))
    return long_features(joins.zip_features(x, more))


_EXO = (
    f"{WX}, dy AS (SELECT DISTINCT hour::DATE AS day FROM wx), hh AS (SELECT unnest(range(0, 24))::INT AS h), near AS (SELECT day, h,"
    " arg_min({c}, abs(hour(hour) - h) * 100 + hour(hour)) AS t FROM dy, hh JOIN wx ON wx.hour::DATE = day GROUP BY 1, 2),"
    " ex AS (SELECT vec_id AS sample_id, (a * 24 + h)::INT AS pos, t AS x FROM embeddings, (SELECT unnest(range(0, 2))::INT AS a), hh"
    " LEFT JOIN near USING (h) WHERE day = DATE '2024-01-05' + (vec_id % 20 - 1 + a)::INT)"
)


def exogenous(spark, sf, column):
    day = F.date_add(F.lit("2024-01-05").cast("date"), (F.col("sample_id") % 20).cast("int"))
    v = samples(spark, sf).select("sample_id", day.alias("visit_date"))
    out = joins.exogenous_window(v, weather(spark, sf), 2, column=column, key="sample_id")
    return out.withColumnRenamed(column, "features")


@query("n12_exogenous_replaces", f"WITH {_EXO.format(c='temp_c')} SELECT {OUT} FROM ex")
def _(spark, sf):
    exo = {"TEMPERATURE": exogenous(spark, sf, "temp_c")}
    return long_features(normalise.apply_steps(samples(spark, sf), ["TEMPERATURE"], exogenous=exo))


@query(
    "n12_exogenous_appended",
    f"WITH {X}, {_EXO.format(c='humidity')} SELECT {OUT} FROM (SELECT sample_id, pos, x FROM x UNION ALL SELECT sample_id, pos + 64, x FROM ex)",
)
def _(spark, sf):
    exo = {"HUMIDITY": exogenous(spark, sf, "humidity")}
    return long_features(normalise.apply_steps(samples(spark, sf), ["HUMIDITYAPPEND"], exogenous=exo))


@query(
    "k2_fit_then_transform",
    f"WITH {X}, ps AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std FROM x WHERE label < 5 GROUP BY 1) SELECT sample_id, pos, {q6('(x - mean) / std')} AS x"
    " FROM x JOIN ps USING (pos) WHERE label >= 5",
)
def _(spark, sf):
    x = samples(spark, sf)
    params = normalise.fit_positions(x.filter(F.col("label") < 5), {"mean": F.avg, "std": F.stddev_pop})
    out = normalise.transform_positions(x.filter(F.col("label") >= 5), params, lambda v, p: (v - p["mean"]) / p["std"])
    return long_features(out)


@query("k4_row_expressions", f"WITH {X} SELECT sample_id, {q6('sum(x)')} AS total, {q6('max(x)')} AS top FROM x GROUP BY 1")
def _(spark, sf):
    return samples(spark, sf).select(
        "sample_id", r6(normalise.array_sum(F.col("features"))).alias("total"), r6(F.array_max("features")).alias("top")
    )


# -- spectral ----------------------------------------------------------------


def _values(rows):
    return "(VALUES " + ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows) + ")"


def _stft_kernel(width):
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / width) for i in range(width)]
    total = sum(window)
    rows = []
    for k in range(width // 2 + 1):
        for i in range(width):
            angle = 2 * math.pi * k * i / width
            rows.append((k, i, window[i] * math.cos(angle) / total, -window[i] * math.sin(angle) / total))
    return _values(rows)


def _stft_sql(source, n, width, keys="sample_id"):
    hop = width // 2
    frames = n // hop + 1  # the widths here divide the lengths: one frame centred on every hop, both ends included
    return (
        f"k AS (SELECT * FROM {_stft_kernel(width)} t(freq, i, re, im)), f AS (SELECT unnest(range(0, {frames})) AS frame),"
        f" sp AS (SELECT {keys}, freq, frame, sum(x * re) AS re, sum(x * im) AS im FROM {source}, f JOIN k ON i = pos + {width // 2} - frame * {hop}"
        f" GROUP BY ALL), st AS (SELECT {keys}, (freq * {frames} + frame)::INT AS pos, re * re + im * im AS x FROM sp)"
    )


@query("s1_stft_power", f"WITH {X}, {_stft_sql('x', 64, 16)} SELECT {OUT} FROM st")
def _(spark, sf):
    return long_features(spectral.stft_power(samples(spark, sf), 16))


def _cwt_sql(scales, wavelet, f0, n=64):
    def gain(w):
        if wavelet == "morlet":
            return math.exp(-((w - f0) ** 2) / 2) / math.pi**0.25
        return w * w * math.exp(-w * w / 2) / math.sqrt(0.75 * math.sqrt(math.pi))

    # angular frequency of each term, the upper half negative; a wavelet of scale s has the norm of a unit one
    turn = [2 * math.pi * (k if k < n / 2 else k - n) / n for k in range(n)]
    filt = [(i, k, math.sqrt(2 * math.pi * s) * gain(s * turn[k])) for i, s in enumerate(scales) for k in range(n)]
    dft = [(k, p, math.cos(2 * math.pi * k * p / n), math.sin(2 * math.pi * k * p / n)) for k in range(n) for p in range(n)]
    return (
        f"ft AS (SELECT * FROM {_values(filt)} t(scale, k, g)), dft AS (SELECT * FROM {_values(dft)} t(k, p, c, s)),"
        " xh AS (SELECT sample_id, k, sum(x * c) AS re, -sum(x * s) AS im FROM x JOIN dft ON p = pos GROUP BY 1, 2),"
        f" cw AS (SELECT sample_id, scale, p, sqrt((sum(g * (re * c - im * s)) / {n}) ** 2 + (sum(g * (re * s + im * c)) / {n}) ** 2) AS x"
        " FROM xh JOIN ft USING (k) JOIN dft USING (k) GROUP BY 1, 2, 3)"
    )


SCALES = [2.0, 2 * 2**0.5, 4.0, 4 * 2**0.5, 8.0, 8 * 2**0.5, 16.0, 16 * 2**0.5]  # four octaves from 2 on, two voices each
CWT = f"{X}, {_cwt_sql(SCALES, 'morlet', 6.0)}"


@query("s2_cwt_magnitude", f"WITH {CWT} SELECT sample_id, (scale * 64 + p)::INT AS pos, {q6('x')} AS x FROM cw")
def _(spark, sf):
    return long_features(spectral.cwt_magnitude(samples(spark, sf), SCALES))


@query(
    "s2_cwt_mexican_hat",
    f"WITH {X}, {_cwt_sql(SCALES, 'mexican_hat', 0.0)} SELECT sample_id, (scale * 64 + p)::INT AS pos, {q6('x')} AS x FROM cw",
)
def _(spark, sf):
    return long_features(spectral.cwt_magnitude(samples(spark, sf), SCALES, wavelet="mexican_hat"))


# the cone widens with the distance to the nearer end, on a log axis stretched over the scales
_CONE = _values([(p, math.floor(len(SCALES) * math.log2(1 + 2 * min(p, 63 - p)) / math.log2(63) + 1e-9)) for p in range(64)])

# fixed values: low-pass taps of the decompositions
_COIF1 = [-0.01565572813546454, -0.0727326195128539, 0.38486484686420286, 0.8525720202122554, 0.3378976624578092, -0.0727326195128539]
_DB4 = [
    -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
    -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523,
]


def _taps(low):
    """``(k, lo, hi)``: the high-pass is the low-pass backwards with alternating sign."""
    n = len(low)
    return _values([(k, low[k], -low[n - 1 - k] if k % 2 == 0 else low[n - 1 - k]) for k in range(n)])


@query(
    "s3_cone_of_influence",
    f"WITH {CWT}, co AS (SELECT * FROM {_CONE} t(p, lim)) SELECT sample_id, (scale * 64 + p)::INT AS pos, CASE WHEN scale < lim THEN {q6('x')} END AS x"
    " FROM cw JOIN co USING (p)",
)
def _(spark, sf):
    return long_features(spectral.cwt_magnitude(samples(spark, sf), SCALES, cone=True))


@query("s4_scale_deviation", f"WITH {CWT} SELECT sample_id, scale::INT AS pos, {q6('stddev_pop(x)')} AS x FROM cw GROUP BY 1, 2")
def _(spark, sf):
    image = spectral.cwt_magnitude(samples(spark, sf), SCALES)
    return long_features(spectral.scale_deviation(image, 64))


@query(
    "s4_deviation_inside_cone",
    f"WITH {CWT}, co AS (SELECT * FROM {_CONE} t(p, lim)) SELECT sample_id, scale::INT AS pos, {q6('stddev_pop(CASE WHEN scale < lim THEN x END)')} AS x"
    " FROM cw JOIN co USING (p) GROUP BY 1, 2",
)
def _(spark, sf):
    return long_features(spectral.cwt_deviation(samples(spark, sf), SCALES, cone=True))


def _dwt_level(src, dst, n):
    taps = _taps(_COIF1)
    size = (n + 5) // 2
    j = "2 * i + 1 - k"
    return (
        f"{dst} AS (SELECT {src}.sample_id, i, sum(lo * x) AS a, sum(hi * x) AS d FROM (SELECT unnest(range(0, {size}))::INT AS i) ii, {taps} t(k, lo, hi)"
        f" JOIN {src} ON pos = CASE WHEN {j} < 0 THEN -1 - ({j}) WHEN {j} >= {n} THEN {2 * n - 1} - ({j}) ELSE {j} END GROUP BY 1, 2)"
    )


@query(
    "s5_dwt_scalogram",
    f"WITH {X}, {_dwt_level('x', 'l1', 64)}, x1 AS (SELECT sample_id, i AS pos, a AS x FROM l1), {_dwt_level('x1', 'l2', 34)},"
    " tt AS (SELECT unnest(range(0, 68))::INT AS t)"
    f" SELECT sample_id, t AS pos, {q6('d')} AS x FROM l2 JOIN tt ON i = t // 4 UNION ALL SELECT sample_id, 68 + t, {q6('d')} FROM l1 JOIN tt ON i = t // 2",
)
def _(spark, sf):
    return long_features(spectral.dwt_scalogram(samples(spark, sf)))


_H = repr(0.7071067811865476)


@query(
    "s6_wavelet_denoise",
    f"WITH {X}, mx AS (SELECT sample_id, 0.35 * max(x) AS t FROM x GROUP BY 1), c AS (SELECT e.sample_id, e.pos // 2 AS i, {_H} * (o.x + e.x) AS a,"
    f" {_H} * (o.x - e.x) AS d FROM x e JOIN x o ON o.sample_id = e.sample_id AND o.pos = e.pos + 1 WHERE e.pos % 2 = 0),"
    f" s AS (SELECT c.sample_id, i, a, sign(d) * greatest(abs(d) - t, 0) AS d FROM c JOIN mx USING (sample_id))"
    f" SELECT sample_id, (2 * i)::INT AS pos, {q6(f'{_H} * (a - d)')} AS x FROM s UNION ALL SELECT sample_id, (2 * i + 1)::INT, {q6(f'{_H} * (a + d)')} FROM s",
)
def _(spark, sf):
    return long_features(spectral.denoise(samples(spark, sf), 0.35, "haar", levels=1))


def _circle_down(src, dst, n):
    """One level on a circle of ``n`` cells: approximation and detail of every other cell."""
    return (
        f"{dst} AS (SELECT x.sample_id, i, sum(lo * x.x) AS a, sum(hi * x.x) AS d FROM (SELECT unnest(range(0, {n // 2}))::INT AS i) ii, {_taps(_DB4)} t(k, lo, hi)"
        f" JOIN {src} x ON x.pos = (2 * i + 4 - k + {n}) % {n} GROUP BY 1, 2)"
    )


def _circle_up(rest, level, dst, n):
    """Back up: every coefficient spreads over the cells that it was read from, details after the soft threshold."""
    return (
        f"{dst} AS (SELECT l.sample_id, ((2 * l.i + 4 - k + {n}) % {n})::INT AS pos, sum(lo * r.x + hi * sign(d) * greatest(abs(d) - lim, 0)) AS x"
        f" FROM {level} l JOIN {rest} r ON r.sample_id = l.sample_id AND r.pos = l.i JOIN mx ON mx.sample_id = l.sample_id, {_taps(_DB4)} t(k, lo, hi) GROUP BY 1, 2)"
    )


@query(
    "s6_wavelet_denoise_db4",
    f"WITH {X}, mx AS (SELECT sample_id, 0.35::DOUBLE * max(x) AS lim FROM x GROUP BY 1), {_circle_down('x', 'l1', 64)},"
    f" x1 AS (SELECT sample_id, i AS pos, a AS x FROM l1), {_circle_down('x1', 'l2', 32)}, x2 AS (SELECT sample_id, i AS pos, a AS x FROM l2),"
    f" {_circle_down('x2', 'l3', 16)}, x3 AS (SELECT sample_id, i AS pos, a AS x FROM l3), {_circle_up('x3', 'l3', 'y2', 16)}, {_circle_up('y2', 'l2', 'y1', 32)},"
    f" {_circle_up('y1', 'l1', 'y0', 64)} SELECT sample_id, pos, {q6('x')} AS x FROM y0",
)
def _(spark, sf):
    return long_features(spectral.denoise(samples(spark, sf), 0.35))


@query(
    "s7_dashboard_spectrogram",
    f"WITH {HOURLY}, a AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN pos END) OVER (PARTITION BY series_id ORDER BY pos) AS lp,"
    " min(CASE WHEN value IS NOT NULL THEN pos END) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np,"
    " max(pos) OVER (PARTITION BY series_id) + 1 AS n FROM g), fl AS (SELECT a.series_id, a.pos, coalesce(a.value, l.value + (r.value - l.value) * (a.pos - lp) / (np - lp)) AS v"
    " FROM a LEFT JOIN g l ON l.series_id = a.series_id AND l.pos = lp LEFT JOIN g r ON r.series_id = a.series_id AND r.pos = np"
    " WHERE a.pos < n // 168 * 168), src AS (SELECT series_id, pos // 168 AS block, (pos % 168)::INT AS pos, v AS x FROM fl),"
    f" {_stft_sql('src', 168, 24, 'series_id, block')} SELECT series_id, block, pos, {q6('x')} AS x FROM st",
)
def _(spark, sf):
    filled = runlength.linear_fill(sparse_hourly(spark, sf))
    weeks = grid.to_blocks(grid.crop_to_blocks(filled, 168), 168).withColumnRenamed("values", "features")
    out = spectral.stft_power(weeks, 24)
    return out.select("series_id", "block", F.posexplode("features").alias("pos", "x")).withColumn("x", r6("x"))


def _kernel_rows(scales):
    rows = []
    for n, s in enumerate(scales):
        wide = math.ceil(5 * s)
        for t in range(-wide, wide + 1):
            size = math.exp(-((t / s) ** 2) / 2) / math.pi**0.25 / math.sqrt(s)
            rows.append((n, t, size * math.cos(6 * t / s), size * math.sin(6 * t / s)))
    return _values(rows)


@query(
    "s7_long_scalogram",
    f"WITH {HOURLY}, a AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN pos END) OVER (PARTITION BY series_id ORDER BY pos) AS lp,"
    " min(CASE WHEN value IS NOT NULL THEN pos END) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np FROM g),"
    " fl AS (SELECT a.series_id, a.pos, coalesce(a.value, l.value + (r.value - l.value) * (a.pos - lp) / (np - lp)) AS v"
    " FROM a LEFT JOIN g l ON l.series_id = a.series_id AND l.pos = lp LEFT JOIN g r ON r.series_id = a.series_id AND r.pos = np),"
    f" k AS (SELECT * FROM {_kernel_rows([2.0, 4.0, 8.0])} t(scale, o, re, im)), c AS (SELECT fl.series_id, fl.pos + o AS pos, scale, sum(v * re) AS re, sum(v * im) AS im FROM fl, k GROUP BY ALL)"
    f" SELECT c.series_id, c.pos, scale::INT AS scale, {q6('sqrt(re * re + im * im)')} AS x FROM c SEMI JOIN g ON g.series_id = c.series_id AND g.pos = c.pos",
)
def _(spark, sf):
    filled = runlength.linear_fill(sparse_hourly(spark, sf))
    out = spectral.long_magnitude(filled, [spectral.morlet_kernel(s) for s in (2.0, 4.0, 8.0)], block=256)
    return out.withColumn("x", r6("x"))


@query(
    "s9_class_mean_image",
    f"WITH {CWT}, lb AS (SELECT vec_id AS sample_id, label FROM embeddings) SELECT label, scale::BIGINT AS scale, p::INT AS pos, {q6('avg(x)')} AS mean FROM cw JOIN lb USING (sample_id) GROUP BY 1, 2, 3",
)
def _(spark, sf):
    image = spectral.cwt_magnitude(samples(spark, sf), SCALES)
    return spectral.class_mean_image(image, 64).withColumn("mean", r6("mean"))


def _upsample_kernel(n, size):
    rows = []
    for m in range(size):
        for p in range(n):
            t = 2 * math.pi * (m / size - p / n)
            v = 1 + 2 * sum(math.cos(k * t) for k in range(1, n // 2)) + math.cos(n // 2 * 2 * math.pi * m / size) * math.cos(math.pi * p)
            rows.append((m, p, v / n))
    return _values(rows)


@query(
    "s10_fourier_upsampling",
    f"WITH {X}, k AS (SELECT * FROM {_upsample_kernel(64, 92)} t(m, p, w)) SELECT sample_id, m::INT AS pos, {q6('sum(w * x)')} AS x FROM x JOIN k ON p = pos GROUP BY 1, 2",
)
def _(spark, sf):
    return long_features(spectral.fourier_resample(samples(spark, sf)))


@query(
    "s11_availability_weights",
    f"WITH {HX}, w0 AS (SELECT sample_id, pos, (x IS NOT NULL)::INT::DOUBLE AS w FROM hx), s1 AS (SELECT sample_id, pos // 2 AS c, sum(w) AS w FROM w0 GROUP BY 1, 2),"
    " w1 AS (SELECT w0.sample_id, pos, s1.w FROM w0 JOIN s1 ON s1.sample_id = w0.sample_id AND c = pos // 2), s2 AS (SELECT sample_id, pos // 4 AS c,"
    " sum(DISTINCT w) AS w FROM w1 GROUP BY 1, 2), w2 AS (SELECT w1.sample_id, pos, s2.w FROM w1 JOIN s2 ON s2.sample_id = w1.sample_id AND c = pos // 4),"
    " s3 AS (SELECT sample_id, pos // 6 AS c, sum(DISTINCT w) AS w FROM w2 GROUP BY 1, 2), w3 AS (SELECT w2.sample_id, pos, s3.w FROM w2 JOIN s3"
    f" ON s3.sample_id = w2.sample_id AND c = pos // 6) SELECT {OUT} FROM (SELECT sample_id, pos, w AS x FROM w3 UNION ALL SELECT sample_id, pos + 64, w FROM w2"
    " UNION ALL SELECT sample_id, pos + 128, w FROM w1 UNION ALL SELECT sample_id, pos + 192, w FROM w0)",
)
def _(spark, sf):
    return long_features(spectral.availability_weights(holed(spark, sf), 4))
