"""Rows that move: what is shuffled, written or compared must follow the input, not its square."""

import datetime
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tracelab.operators import evaluate, grid, impute, joins, neighbours, runlength, splits
from tracelab.plans.catalogue import QUERIES
from tracelab.plans.trace_queries import imputed_grid
from tracelab.sources import tables


@pytest.fixture
def joined(monkeypatch):
    """The rows of both sides of every join that is written down while the test runs."""
    sizes = []
    kept = DataFrame.join

    def join(self, other, *args, **kwargs):
        sizes.append((self, other))
        return kept(self, other, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "join", join)
    return sizes


@pytest.fixture
def grouped(monkeypatch):
    """The tables that are grouped while the test runs."""
    tables = []
    kept = DataFrame.groupBy

    def group(self, *cols):
        tables.append((self,))
        return kept(self, *cols)

    monkeypatch.setattr(DataFrame, "groupBy", group)
    return tables


def most(sides) -> int:
    return max(df.count() for pair in list(sides) for df in pair)


def test_individuals_of_many_blocks_are_copied_a_few_times(spark, joined):
    """Both sides of the join; before, each had a copy of every individual for every 4,096 others."""
    df = spark.range(150_000).select(F.col("id").alias("series_id"), (F.col("id") % 3).cast("int").alias("target"))
    splits.leave_two_out(df)
    assert most(joined) <= 10 * 150_000
    splits.leave_two_out(df.withColumn("target", F.col("target").isin(1).cast("int")), stratified=True)
    assert most(joined) <= 16 * 150_000


@pytest.mark.parametrize("stratified", [False, True])
def test_pairs_are_made_where_blocks_meet(spark, joined, stratified):
    rnd = random.Random(5)
    rows = [(s, rnd.randint(0, 1)) for s in [None, *range(299)] for _ in range(rnd.randint(1, 2))]
    df = spark.createDataFrame(rows, "series_id LONG, target INT")
    got = [(r.a, r.b) for r in splits.leave_two_out(df, stratified=stratified).collect()]
    classes = {}
    for s, t in rows:
        classes.setdefault(s, set()).add(t)
    want = [p for p in itertools.combinations([*range(299), None], 2) if not stratified or len(classes[p[0]]) == len(classes[p[1]]) == 1 and classes[p[0]] != classes[p[1]]]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert most(joined) <= 8 * 300  # every pair was shuffled on its own


@pytest.mark.parametrize("k", [3, None])
def test_candidates_of_a_cell_are_not_shuffled(spark, joined, k):
    rng = random.Random(3)
    rows = [(i, i % 3 if i % 3 < 2 else None, i % 2, [rng.random() for _ in range(12)]) for i in range(400)]
    rows += [(7, 1, 1, [0.5] * 12), (None, 1, 0, [0.5] * 12)]  # an id with two rows, and a row without an id
    df = spark.createDataFrame(rows, "sample_id long, y int, fold int, features array<double>")
    got = neighbours.nearest(df, k, block_rows=16)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not joined and "Window" not in plan  # every cell's nearest rows were shuffled, ranked and joined
    apart = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    want = {}
    for i in {r[0] for r in rows} - {None}:
        own = [r for r in rows if r[0] == i]
        near = sorted((round(apart(o[3], r[3]), 9), -1 if r[0] is None else r[0], str(r[1])) for o in own for r in rows if r[2] != o[2])
        most = k if k is not None else int(sum(r[2] != own[0][2] for r in rows) ** 0.5)
        want[i] = near[:most]
    found = {}
    for r in got.collect():
        found.setdefault(r.sample_id, []).append((round(r.distance, 9), -1 if r.neighbour is None else r.neighbour, str(r.y)))
    assert {i: sorted(v) for i, v in found.items()} == want


def test_herd_windows_are_not_grouped_again(spark, grouped):
    rng = random.Random(1)
    day = 86400
    records = [(s, rng.randint(0, 5 * day), float(rng.randint(1, 50))) for s in range(30) for _ in range(12)] + [(None, day, 1.0), (3, 2 * day, None)]
    stops = [(k, rng.randint(-day, 9 * day)) for k in range(60)] + [(5, 3 * day), (None, 2 * day), (None, 3 * day), (70, None), (71, 3 * day), (71, 3 * day)]
    df = spark.createDataFrame(records, "series_id int, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    samples = spark.createDataFrame(stops, "sample_id int, s long").select("sample_id", F.timestamp_seconds("s").alias("stop"))
    got = {(r.sample_id, r.series_id): (r.n, round(r.total, 6)) for r in joins.herd_window_sums(df, samples, 2).collect()}
    want = {}
    for k, stop in stops:
        for s, t, v in records:
            if s is not None and stop is not None and stop - 2 * day < t <= stop:
                n, total = want.get((k, s), (0, 0.0))
                want[k, s] = (n + 1, total + (v or 0.0))
    assert got == want
    assert most(grouped) <= len(records) < len(want) / 2  # two rows per sample and animal were grouped


@pytest.mark.parametrize(("step", "lo"), [("1 hour", 0), ("10 minutes", 7), ("1 day", 0)])
def test_steps_are_written_out_behind_the_join(spark, joined, step, lo):
    n = grid.seconds(step)
    rng = random.Random(n)
    rows = [(s, lo + 60 * s + n * t, float(t) if t % 3 else None) for s in range(3) for t in sorted(rng.sample(range(-60, 400), 25))] + [(None, 0, 1.0)]
    df = spark.createDataFrame(rows, "series_id int, s long, value double").select("series_id", F.timestamp_seconds("s").alias("ts"), "value")
    got = {(r.series_id, r.t): (r.pos, r.value) for r in grid.regular_grid(df, step).select("*", F.unix_seconds("ts").alias("t")).collect()}
    want = {}
    for s in (0, 1, 2, None):
        own = {t: v for k, t, v in rows if k == s}
        first, last = min(own), max(own)
        for t in range(first, last + 1, n):
            want[s, t] = ((t - first) // n, own.get(t) if s is not None else None)
    assert got == want
    assert most(joined) < len(want) / (4 if n < 86400 else 1) + 8  # every step was joined with the records, and shuffled for it


def test_cells_of_a_silent_herd_are_not_joined(spark, joined):
    df = spark.createDataFrame([(1, 0, 2.0), (2, 86400 * 9, 3.0)], "series_id int, s long, value double").select("series_id", F.timestamp_seconds("s").alias("ts"), "value")
    ids = spark.range(50).select(F.col("id").cast("int").alias("series_id"))
    got = grid.common_grid(df, "1 hour", ids=ids)
    assert got.count() == 50 * 241 and got.where("value is not null").count() == 2
    assert most(joined) <= 50 * 11


def test_a_mark_is_not_copied_to_every_cell(spark, joined):
    rng = random.Random(4)
    marks = [(s, p, rng.randint(1, 5)) for s in range(3) for p in rng.sample(range(-20, 300), 60)]
    cells = spark.range(300).selectExpr("explode(array(0, 1, 2, 3)) AS series_id", "id AS pos")
    df = spark.createDataFrame(marks, "series_id int, pos long, mark int")
    got = {(r.series_id, r.pos): r.mark for r in joins.mark_before(cells, df, 48).collect()}
    want = {}
    for s in range(4):
        for p in range(300):
            ahead = [(q, m) for k, q, m in marks if k == s and p < q <= p + 48]
            want[s, p] = max(ahead)[1] if ahead else None
    assert got == want
    assert joined[-1][1].count() <= 2 * len(marks) / 6  # a list per block of 48 cells; it was a row per marked cell


def records(spark):
    """Hourly sums with long gaps, a null sum, a series with one record, one without a name and one without a time."""
    rng = random.Random(4)
    rows = [(k, f"2024-01-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:00:00", rng.choice([None, 0.0, 1.5, 7.25])) for k in range(5) for _ in range(12)]
    rows = list({(k, t): (k, t, v) for k, t, v in rows}.values())
    rows += [(7, "2024-01-09 05:00:00", 2.0), (None, "2024-01-03 00:00:00", 3.0), (None, "2024-01-03 04:00:00", 4.0), (8, None, 5.0), (1, None, 6.0)]
    rows += [(9, "2024-01-01 00:00:00", None), (9, "2024-05-01 00:00:00", 1.0)]
    return spark.createDataFrame(rows, "series_id int, t string, value double").select("series_id", F.to_timestamp("t").alias("ts"), "value")


FILLS = {
    "linear_fill": (), "linear_then_zero": (), "nearest_fill": (), "hold_leading": (), "constant_fill": (6,),
}


@pytest.mark.parametrize("name", FILLS)
def test_fills_of_listed_cells_are_those_of_the_grid(spark, name):
    """The same cells as on the written grid, and none of them is grouped, sorted or joined after it was written out."""
    rows, cols = records(spark), ["series_id", "pos", "value"]
    kinds = ((grid.regular_grid, runlength.own_grid), (grid.common_grid, runlength.herd_grid))
    for dense, listed in kinds:
        want = getattr(impute, name)(dense(rows, "1 hour"), *FILLS[name]).select(*cols)
        got = getattr(runlength, name)(listed(rows, "1 hour"), *FILLS[name])
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
        written_last(got)


def written_last(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = min(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert not any(word in line for line in plan[:first] for word in ("Window", "Join", "Aggregate", "Sort"))


def test_masked_cells_are_filled_without_a_shuffle_of_the_grid(spark):
    out = imputed_grid(spark, "/root/testdata/sf0.001")
    written_last(out)
    assert out.where("masked = 1 and (truth is null or truth = 0)").count() == 0 and out.where("masked is null").count() == 0
    assert out.where("masked = 1").count() > 50


def test_draws_are_made_by_all_tasks(spark):
    """Few ids with many replicates: each task draws for its own ids, and arrays of weights hold every draw."""
    ids = spark.range(50).select(F.when(F.col("id") > 0, F.col("id")).alias("series_id"))
    draws = splits.resample_weights(ids, "series_id", 40, 3)
    assert "RepartitionByExpression [no" in draws._jdf.queryExecution().optimizedPlan().toString()
    want = {(r.series_id, r.replicate): r.times for r in draws.collect()}
    assert sum(want.values()) == 49 * 40  # a null id is not counted
    got = {(r.series_id, i): n for r in evaluate.weight_arrays(draws, "series_id", 40).collect() for i, n in enumerate(r.weights, 1) if n}
    assert got == want


def test_windows_meet_animals_as_matrices(spark, monkeypatch):
    """Several blocks on both sides, several matrices in a block, records at a window's ends, ids that repeat; before, each pair was a row of a join."""
    monkeypatch.setattr(joins, "WINDOWS", 5)
    monkeypatch.setattr(joins, "ANIMALS", 4)
    monkeypatch.setattr(joins, "CELLS", 9)
    rng = random.Random(12)
    start = datetime.datetime(2024, 3, 1, tzinfo=datetime.UTC)
    moment = lambda: start + datetime.timedelta(seconds=600 * rng.randrange(0, 144 * 8))
    records = [(i % 11, moment(), rng.choice([None, 1.0, 2.5, -4.0])) for i in range(300)]
    stops = [(i % 35, rng.choice([moment(), records[i][1], records[i][1] + datetime.timedelta(days=2)])) for i in range(40)] + [(90, None), (91, start - datetime.timedelta(days=9))]
    out = joins.herd_window_sums(spark.createDataFrame(records, "series_id long, ts timestamp, value double"), spark.createDataFrame(stops, "sample_id long, stop timestamp"), 2)
    want = {}
    for sample, stop in stops:
        for series, ts, value in records:
            if stop is not None and stop - datetime.timedelta(days=2) < ts <= stop:
                n, total = want.get((sample, series), (0, 0.0))
                want[sample, series] = n + 1, total + (value or 0.0)
    assert {(r.sample_id, r.series_id): (r.n, round(r.total, 6)) for r in out.collect()} == want
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_the_herd_is_sent_to_the_cells_of_all_windows(spark, tmp_path):
    """The herd's series is a row per hour; before, its size was not known and the cells of all windows were dealt out by time."""
    rng = random.Random(3)
    start = datetime.datetime(2024, 3, 1, tzinfo=datetime.UTC)
    rows = [(i, i % 40, start + datetime.timedelta(seconds=rng.randrange(86400 * 3)), rng.random(), "click") for i in range(4000)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double, event_type string")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plan = QUERIES["c14_reference_trace"](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert re.search(r"BroadcastHashJoin \[ts#\d+\], \[ts#\d+\]", plan)


def test_near_rows_are_put_among_the_nearest_together(monkeypatch):
    """Ties, equal rows and distances that are no numbers, next to all pairs; before, each row was sorted again at every cell it met."""
    rng = np.random.default_rng(7)
    rows, train, cells = rng.integers(0, 4, (300, 3)).astype(float), rng.integers(0, 4, (900, 3)).astype(float), 12
    train[5], rows[9] = np.nan, np.inf
    k = np.where(np.arange(300) % 3 == 0, 7, 20)
    k[4] = 0
    table = pa.table({
        "sample_id": np.arange(300), "fold": np.arange(300, dtype=np.int32) % 2, "features": pa.array(rows.tolist()), "k": k,
        "cells": pa.array([list(range(cells))] * 300, pa.list_(pa.int32())),
    })
    sorts = []
    kept = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorts.append(1) or kept(keys))
    monkeypatch.setattr(neighbours, "MERGED", 2000, raising=False)
    held = neighbours.Held.of(table)
    folds = np.arange(900) % 3
    for c in range(cells):
        own = np.arange(c, 900, cells)
        held.meet(c, own, own % 2.0, folds[own], train[own])
    met = len(sorts)
    got = {}
    for b in held.found():
        for r in b.to_pylist():
            got.setdefault(r["sample_id"], []).append(r["neighbour"])
    with np.errstate(all="ignore"):
        d = ((train[None] - rows[:, None]) ** 2).sum(2)
    for i in range(300):
        own = np.nonzero(folds != i % 2)[0]
        best = own[kept((own, d[i, own]))][: k[i]]
        assert got.get(i, []) == best.tolist()
    assert met <= 3 * 300  # a row is sorted by itself only where others are as near as its last one


def test_a_folder_per_series_holds_one_file_per_task(spark, tmp_path):
    """On a local disk; before, there was a checksum file beside each."""
    df = spark.range(60).select((F.col("id") % 20).alias("series_id"), F.col("id").alias("event_id"), F.lit(0.5).alias("value"))
    tables.write_per_series(df, str(tmp_path / "out"), {"value": "activity"})
    names = [f.name for f in (tmp_path / "out").glob("series_id=*/*")] + [f.name for f in (tmp_path / "out").glob("series_id=*/.*")]
    assert len(names) >= 20 and not [n for n in names if n.endswith(".crc")]
    read = spark.read.schema("event_id LONG, activity DOUBLE, series_id LONG").option("header", True).csv(str(tmp_path / "out"))
    assert sorted((r.series_id, r.event_id, r.activity) for r in read.collect()) == sorted((i % 20, i, 0.5) for i in range(60))
