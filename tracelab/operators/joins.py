"""Joins of traces, visits and exogenous readings.

Range joins are cut into day buckets and become hash equi-joins with a residual filter, so the
work per key is spread over its days.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.functions.scan import ranked, scan
from tracelab.session import materialise

DAY = 86400
WINDOWS = 8192  # windows of a block
ANIMALS = 2048  # animals of a block, fewer if they have many records
CELLS = 2**18  # windows times animals that are told at a time


def day_number(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / DAY)


def interval_join(
    records: DataFrame,
    spans: DataFrame,
    *,
    keys: Sequence[str] = ("series_id",),
    start: str = "start",
    stop: str = "stop",
    ts: str = "ts",
    open_start: bool = True,
    how: str = "inner",
) -> DataFrame:
    """Records inside each span of the same key (C1): ``start < ts <= stop``, or both ends closed.

    A span is exploded into the days it touches; ``how='left'`` keeps records without a span.
    """
    days = F.sequence(day_number(F.col(start)), day_number(F.col(stop)))
    cut = spans.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[c for c in spans.columns if c not in keys],
        F.explode(days).alias("_span_day"),
    )
    left = records.withColumn("_day", day_number(F.col(ts)))
    on = F.col("_day") == F.col("_span_day")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    lower = F.col(ts) > F.col(start) if open_start else F.col(ts) >= F.col(start)
    on = on & lower & (F.col(ts) <= F.col(stop))
    return left.join(cut, on, how).drop("_day", "_span_day", *[f"_k_{k}" for k in keys])


def match_short_ids(tags: DataFrame, full: DataFrame, *, digits: int, tag: str, full_id: str) -> DataFrame:
    """Tags against full ids by their last digits; unmatched tags keep a null id."""
    short = F.pmod(F.col(full_id), F.lit(10**digits))
    return tags.join(full.select(full_id, short.alias("_short")), F.col(tag) == F.col("_short"), "left").drop("_short")


def unmatched_tags(tags: DataFrame, full: DataFrame, *, digits: int, tag: str, full_id: str) -> DataFrame:
    """Tags no full id ends in."""
    short = full.select(F.pmod(F.col(full_id), F.lit(10**digits)).alias(tag))
    return tags.join(short, tag, "left_anti")


def remap_ids(df: DataFrame, mapping: DataFrame, *, key: str, old: str = "old_id", new: str = "new_id") -> DataFrame:
    """Replace ids through a mapping table; ids without an entry are left out."""
    pairs = mapping.select(F.col(old).alias(key), F.col(new).alias("_new"))
    return df.join(pairs, key).withColumn(key, F.col("_new")).drop("_new")


def same_day_value(visits: DataFrame, weights: DataFrame, column: str) -> DataFrame:
    """A reading of the same series and day (C4)."""
    return visits.join(weights.select("series_id", "visit_date", column), ["series_id", "visit_date"], "left")


def hourly_lookup(df: DataFrame, weather: DataFrame, columns: Sequence[str], ts: str = "ts") -> DataFrame:
    """Weather of the hour (C5).  Spark broadcasts the table only while it is below its size limit."""
    keyed = df.withColumn("hour", F.date_trunc("hour", ts))
    return keyed.join(weather.select("hour", *columns), "hour", "left")


def exogenous_window(
    visits: DataFrame,
    hourly: DataFrame,
    days: int,
    *,
    column: str,
    offset_days: int = 0,
    descending: bool = False,
    key: str = "visit_id",
    date: str = "visit_date",
) -> DataFrame:
    """Hourly readings of the ``days`` days up to each visit, as one ordered array.

    Oldest day first unless ``descending``; within a day hours ascend.  A gap of a day takes its
    nearest reading; a day without readings is null.  The lookup day by day keeps the join an
    equi-join, and the array has ``24 * days`` cells.
    """
    day_cells = complete_day_cells(hourly, column)
    back = F.sequence(F.lit(0), F.lit(days - 1))
    wanted = visits.select(key, date, F.explode(back).alias("_ago")).withColumn(
        "day", F.date_sub(F.col(date), F.col("_ago") + F.lit(offset_days))
    )
    order = F.col("_ago") if descending else -F.col("_ago")
    missing = F.array_repeat(F.lit(None).cast("double"), 24)
    joined = wanted.join(day_cells, "day", "left").withColumn("_cells", F.coalesce("cells", missing))
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("_cells").alias("c"))))
    return joined.groupBy(key).agg(F.flatten(F.transform(ordered, lambda s: s["c"])).alias(column))


def complete_day_cells(hourly: DataFrame, column: str) -> DataFrame:
    """One row per day with 24 cells; a missing hour takes the nearest known one, earlier on a tie."""
    per_day = hourly.groupBy(F.to_date("hour").alias("day")).agg(
        F.collect_list(F.when(F.col(column).isNotNull(), F.struct(F.hour("hour").alias("h"), F.col(column).alias("v")))).alias("known")
    )

    def nearest(h: Column) -> Column:
        ranked = F.transform("known", lambda k: F.struct(F.abs(k["h"] - h).alias("d"), k["h"].alias("h"), k["v"].alias("v")))
        return F.array_min(ranked)["v"].cast("double")

    return per_day.filter(F.size("known") > 0).select(
        "day", F.transform(F.sequence(F.lit(0), F.lit(23)), nearest).alias("cells")
    )


def attach_points(trace: DataFrame, points: dict[str, DataFrame]) -> DataFrame:
    """Sparse readings at equal ``(series_id, ts)`` (C7): ``{column: readings}``."""
    for name, df in points.items():
        trace = trace.join(df.select("series_id", "ts", name), ["series_id", "ts"], "left")
    return trace


def tolerance_join(buckets: DataFrame, visits: DataFrame, days: int = 5) -> DataFrame:
    """The latest score within ``days`` of each bucket's day.

    Each visit is copied to the days it can serve, reduced to one score per day before the join.
    """
    reach = F.sequence(F.lit(-days), F.lit(days))
    served = visits.select("series_id", "visit_date", "visit_id", "score", F.explode(reach).alias("_o")).select(
        "series_id", F.date_add("visit_date", F.col("_o")).alias("day"), "visit_date", "visit_id", "score"
    )
    one = served.groupBy("series_id", "day").agg(F.max_by("score", F.struct("visit_date", "visit_id")).alias("score"))
    return buckets.join(one, ["series_id", "day"], "left")


def day_join(buckets: DataFrame, visits: DataFrame) -> DataFrame:
    """The day's last score on a bucketed trace."""
    one = visits.groupBy("series_id", F.col("visit_date").alias("day")).agg(F.max_by("score", "visit_id").alias("score"))
    return buckets.join(one, ["series_id", "day"], "left")


def event_at(records: DataFrame, spans: DataFrame, label: str, *, key: Sequence[str], tie: str) -> DataFrame:
    """Label of the latest span that holds each record, -1 when there is none."""
    hit = interval_join(records, spans.select("series_id", "start", "stop", tie, label), open_start=False)
    best = hit.groupBy(*key).agg(F.max_by(label, F.struct("stop", tie)).alias(label))
    return records.join(best, list(key), "left").withColumn(label, F.coalesce(label, F.lit(-1)))


def align_samples(driving: DataFrame, others: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of the driving set whose keys occur in every other set (C11)."""
    for other in others:
        driving = driving.join(other.select(*keys), list(keys), "left_semi")
    return driving


def blank_inside(trace: DataFrame, spans: DataFrame, *, value: str = "value") -> DataFrame:
    """Null the trace inside the spans of the same series.

    Overlapping spans would copy a record, so the hits are reduced to distinct record keys.
    """
    hit = interval_join(trace.select("series_id", "ts"), spans.select("series_id", "start", "stop"), open_start=True)
    hit = hit.select("series_id", "ts").distinct().withColumn("_hit", F.lit(1))
    out = trace.join(hit, ["series_id", "ts"], "left")
    return out.withColumn(value, F.when(F.col("_hit").isNull(), F.col(value))).drop("_hit")


def zip_features(a: DataFrame, b: DataFrame, key: str = "sample_id") -> DataFrame:
    """Features of ``a`` followed by those of ``b`` for the same sample."""
    right = b.select(key, F.col("features").alias("_more"))
    return a.join(right, key).withColumn("features", F.concat("features", "_more")).drop("_more")


def mark_before(cells: DataFrame, marks: DataFrame, n: int) -> DataFrame:
    """Label the ``n`` positions before each marked position; the latest mark wins, of marks at one position the largest.

    Cells meet the marks of their block of ``n`` positions and of the next as one list.

    ``cells``: ``(series_id, pos)``; ``marks``: ``(series_id, pos, mark)``.
    """
    block = lambda c: F.floor(c / F.lit(n))
    one = marks.groupBy("series_id", F.col("pos").alias("at")).agg(F.max("mark").alias("mark"))
    touched = F.explode(F.sequence(block(F.col("at") - n), block(F.col("at") - 1)))  # one block or two
    held = one.select("series_id", "at", "mark", touched.alias("_block")).groupBy("series_id", "_block").agg(F.collect_list(F.struct("at", "mark")).alias("_marks"))
    met = cells.withColumn("_block", block(F.col("pos"))).join(held, ["series_id", "_block"], "left")
    here = F.filter("_marks", lambda m: (m["at"] > F.col("pos")) & (m["at"] <= F.col("pos") + n))
    return met.select(*cells.columns, F.array_max(here)["mark"].alias("mark"))


def outer_join_traces(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Two traces side by side on time."""
    left = a.select("ts", F.col("value").alias(names[0]))
    return left.join(b.select("ts", F.col("value").alias(names[1])), "ts", "full_outer")


def running_totals(records: DataFrame, slot: int = DAY) -> DataFrame:
    """``(series_id, slot, n_before, total_before, times, totals)``: for every series and slot of ``slot`` seconds of the herd's whole span, the records and
    their sum before the slot, and the running sums inside it (C17).

    The span ends one slot after the last record.  A list holds one series' records of one slot.
    """
    at = F.floor(F.unix_seconds("ts") / slot)
    own = records.groupBy("series_id", at.alias("slot")).agg(
        F.sort_array(F.collect_list(F.struct(F.unix_micros("ts").alias("t"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("v")))).alias("_r")
    )
    own = materialise(own, "slots")
    edge = own.groupBy().agg(F.struct(F.min("slot").alias("lo"), (F.max("slot") + 1).alias("hi")).alias("e")).scalar()
    grid = own.select("series_id").distinct().withColumn("_e", edge).select("series_id", F.explode(F.sequence("_e.lo", "_e.hi")).alias("slot"))
    every = grid.join(own, ["series_id", "slot"], "left")
    total = F.aggregate("_r", F.lit(0.0), lambda a, r: a + r["v"])
    summed = scan(
        every, ["series_id"], ["slot"], F.floor(F.col("slot") / 1024),
        cumsum={"_n": F.coalesce(F.size("_r"), F.lit(0)).cast("long"), "_total": F.coalesce(total, F.lit(0.0))},
    )
    inside = F.aggregate(
        "_r", F.array().cast("array<double>"), lambda a, r: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + r["v"]))
    )
    return summed.select(
        "series_id", "slot",
        (F.col("_n") - F.coalesce(F.size("_r"), F.lit(0))).alias("n_before"), (F.col("_total") - F.coalesce(total, F.lit(0.0))).alias("total_before"),
        F.transform("_r", lambda r: r["t"]).alias("times"), F.when(F.size("_r") > 0, inside).alias("totals"),
    )


def herd_window_sums(records: DataFrame, samples: DataFrame, days: int, *, slot: int = DAY) -> DataFrame:
    """``(sample_id, series_id, n, total)``: count and sum of each animal's records in ``(stop - days, stop]``, animals with none left out (C17).

    A window is the difference of two running totals, so that no record meets a sample.  An animal's totals of a window's first and last slot lie in
    one row; these rows meet the samples of that last slot in blocks, as matrices of windows and animals.  Only samples that
    share an id are summed afterwards.
    """
    sums = materialise(running_totals(records, slot), "running-totals")
    edge = sums.groupBy().agg(F.struct(F.min("slot").alias("lo"), F.max("slot").alias("hi")).alias("e")).scalar()
    steps = sorted({days * DAY // slot, -(-days * DAY // slot)})  # slots between a window's last and first
    at = F.floor(F.col("t") / F.lit(slot * 1_000_000))
    stops = samples.where(F.col("stop").isNotNull()).groupBy("sample_id").agg(F.collect_list(F.unix_micros("stop")).alias("_stops"))
    stops = stops.select("sample_id", (F.size("_stops") > 1).alias("several"), F.explode("_stops").alias("t"), (F.col("t") - F.lit(days * DAY * 1_000_000)).alias("s"))
    stops = stops.withColumn("_e", edge).withColumn("slot", at)
    # a window that ends behind the last slot still meets the records of its first; one that ends before the first has none
    stops = stops.where(F.col("slot").between(F.col("_e.lo"), F.col("_e.hi") + steps[-1]))
    points = materialise(stops.select("sample_id", "several", "t", "s", "slot", (F.col("slot") - F.floor(F.col("s") / F.lit(slot * 1_000_000))).cast("int").alias("step")), "window-ends")
    last = sums.withColumn("_e", edge)
    behind = last.where(F.col("slot") == F.col("_e.hi")).select("series_id", F.explode(F.sequence(F.col("slot") + 1, F.col("slot") + steps[-1])).alias("slot"), "n_before", "total_before", "times", "totals")
    ends = sums.unionByName(behind)
    first = sums.select("series_id", F.explode(F.array(*[F.lit(x) for x in steps])).alias("step"), "slot", *[F.col(c).alias(f"f_{c}") for c in ("n_before", "total_before", "times", "totals")])
    first = first.withColumn("slot", F.col("slot") + F.col("step"))
    every = ends.withColumn("step", F.explode(F.array(*[F.lit(x) for x in steps])))
    held = every.join(first, ["series_id", "slot", "step"], "left")
    whole = F.col("n_before") + F.coalesce(F.size("times"), F.lit(0))
    held = materialise(held.where(whole > F.coalesce("f_n_before", F.lit(0))), "window-totals")
    once, again = points.where("not several"), points.where("several")
    rows = _window_differences(once.drop("several"), held)
    if not again.isEmpty():
        shared = _window_differences(again.drop("several"), held).groupBy("sample_id", "series_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        rows = rows.unionByName(shared)
    return rows.where("n > 0")


def _window_differences(points: DataFrame, held: DataFrame) -> DataFrame:
    """``(sample_id, series_id, n, total)``: for each window the differences of all animals' running totals that its slot and step hold.

    Both sides are cut into blocks.  Windows pass by an animals' block in order of time; running totals at all of their ends are a matrix of
    windows and animals, filled from the records in the slot.
    """
    ids = {c: held.schema[c].dataType if c in held.columns else points.schema[c].dataType for c in ("sample_id", "series_id")}
    out = T.StructType([*(T.StructField(c, kind) for c, kind in ids.items()), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])
    on = ["slot", "step"]
    # a block holds so many animals, or so many of their records
    load = F.lit(1) + (F.coalesce(F.size("times"), F.lit(0)) + F.coalesce(F.size("f_times"), F.lit(0))) / 64
    parts = lambda df, size, block, name: df.groupBy(*on).agg(F.ceil(F.sum(size) / block).cast("int").alias(name))
    sizes = parts(points, F.lit(1), WINDOWS, "_lefts").join(parts(held, load, ANIMALS, "_rights"), on)
    sizes = materialise(sizes, "blocks")
    tasks = 8 * points.sparkSession.sparkContext.defaultParallelism
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = points.join(sizes, on).withColumn("_lb", own("sample_id", "_lefts")).withColumn("_rb", every("_rights"))
    right = held.join(sizes, on).withColumn("_rb", own("series_id", "_rights")).withColumn("_lb", every("_lefts"))
    keys = [*on, "_lb", "_rb"]
    lists = ("times", "totals", "f_times", "f_totals")
    fields = [(c, held.schema[c].dataType) for c in ("series_id", "n_before", "total_before", "f_n_before", "f_total_before", *lists)]
    stops = [(c, points.schema[c].dataType) for c in ("sample_id", "t", "s")]
    none = lambda columns: [F.lit(None).cast(kind).alias(c) for c, kind in columns]
    left = left.select(*keys, F.lit(1).alias("kind"), *[c for c, _ in stops], *none(fields))
    right = right.select(*keys, F.lit(0).alias("kind"), *none(stops), *[c for c, _ in fields])
    met = left.unionByName(right).repartition(tasks, *keys).sortWithinPartitions(*keys, "kind", "t")
    at = {c: i for i, c in enumerate(met.columns)}

    def counted(column: pa.Array) -> np.ndarray:
        return column.fill_null(0).to_numpy(zero_copy_only=False)

    def records(times: pa.Array, totals: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Animal, time, and by how much the running total rises there, of every record."""
        some = pa.compute.fill_null(pa.compute.list_value_length(times), 0).to_numpy(zero_copy_only=False)
        who = np.repeat(np.arange(len(some)), some)
        sums = totals.flatten().to_numpy(zero_copy_only=False)
        rise = sums.copy()
        with np.errstate(invalid="ignore"):
            rise[1:] -= np.where(who[1:] == who[:-1], sums[:-1], 0.0)
        return who, times.flatten().to_numpy(zero_copy_only=False), rise

    def reached(ends: np.ndarray, before: np.ndarray, total: np.ndarray, of: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Records and their sum up to each of the rising ends, for every animal."""
        who, times, rise = of
        cell = np.searchsorted(ends, times) * len(before) + who
        shape = (len(ends) + 1, len(before))
        n = np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape)[:-1]
        v = np.bincount(cell, rise, shape[0] * shape[1]).reshape(shape)[:-1]
        return before + np.cumsum(n, 0), total + np.cumsum(v, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, block = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(at[c]).to_numpy() for c in (*keys, "kind")])
            edges = np.nonzero((marks[:, 1:] != marks[:, :-1]).any(0))[0] + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                key, part = tuple(marks[:-1, a]), batch.slice(a, b - a)
                if key != now:
                    now, waiting, block = key, [], None
                if marks[-1, a] == 0:
                    waiting.append(part)
                    continue
                if waiting:
                    table, waiting = pa.Table.from_batches(waiting).combine_chunks(), []
                    column = lambda c: table.column(at[c]).combine_chunks()  # noqa: B023, E731
                    last = counted(column("n_before")), counted(column("total_before")), records(column("times"), column("totals"))
                    first = counted(column("f_n_before")), counted(column("f_total_before")), records(column("f_times"), column("f_totals"))
                    block = column("series_id"), last, first
                if block is None:
                    continue
                animals, last, first = block
                for start in range(0, b - a, max(1, CELLS // len(animals))):
                    some = part.slice(start, max(1, CELLS // len(animals)))
                    (n, total), (n0, total0) = (reached(some.column(at[c]).to_numpy(), *of) for c, of in (("t", last), ("s", first)))
                    n -= n0
                    i, k = np.nonzero(n > 0)
                    with np.errstate(invalid="ignore"):
                        sums = total[i, k] - total0[i, k]
                    columns = [some.column(at["sample_id"]).take(pa.array(i)), animals.take(pa.array(k)), pa.array(n[i, k], pa.int64()), pa.array(sums, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["sample_id", "series_id", "n", "total"])

    return met.mapInArrow(run, out)


def wide_traces(traces: DataFrame, times: DataFrame | None = None, *, width: int = 256) -> tuple[DataFrame, DataFrame]:
    """All traces side by side on time, in blocks of ``width`` columns.

    ``traces``: ``(series_id, ts, value)`` with one row per series and time; the times are all that occur, or those of ``times``.  First ``(ts, block, values)``: a row per time
    and block that has a value there, in the order of the second table, ``(series_id, block, slot)``.  Series are numbered in order of id, so the list of
    them is never held in one place.
    """
    ids = traces.select("series_id").distinct().withColumn("_all", F.lit(0))
    numbered = ranked(ids, ["_all"], ["series_id"], F.floor(F.col("series_id") / 4096), "no")
    columns = materialise(numbered.select("series_id", F.floor((F.col("no") - 1) / width).alias("block"), ((F.col("no") - 1) % width).cast("int").alias("slot")), "columns")
    placed = traces.where(F.col("value").isNotNull()).join(columns, "series_id")
    if times is not None:
        placed = placed.join(times.select("ts").distinct(), "ts", "left_semi")
    sizes = columns.groupBy("block").agg((F.max("slot") + 1).alias("size"))
    found = placed.groupBy("ts", "block").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("_m")).join(sizes, "block")
    values = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.try_element_at("_m", i))
    return found.select("ts", "block", values.alias("values")), columns


def silent_times(wide: DataFrame, times: DataFrame) -> DataFrame:
    """The times at which no trace of any block has a value."""
    return times.select("ts").distinct().join(wide.select("ts").distinct(), "ts", "left_anti")
