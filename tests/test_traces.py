"""Grids, gaps and labelled samples on hand-made tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelab.operators import filters, grid, impute, labels, samples

N = None
GAPS = [N, N, 1, N, 3, N, N, N, 7, 0, 0, 0, 0, 5, N]


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(impute, "BLOCK", 4)


def trace(spark, values, sid=1):
    rows = [(sid, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id INT, pos LONG, value DOUBLE")


def values(df):
    return [r.value for r in df.orderBy("series_id", "pos").collect()]


@pytest.mark.parametrize("limit", [1, 2, 3])
@pytest.mark.parametrize("inclusive", [True, False])
def test_bounded_interpolation(spark, limit, inclusive):
    s = pd.Series(GAPS, dtype=float)
    group = (s.notnull() != s.shift().notnull()).cumsum()
    size = group.groupby(group).transform("count")
    short = size <= limit if inclusive else size < limit
    want = s.interpolate().bfill().where(short | s.notnull())
    got = pd.Series(values(impute.bounded_interpolation(trace(spark, GAPS), limit, inclusive=inclusive)), dtype=float)
    np.testing.assert_allclose(got, want)


def test_other_fills(spark):
    t = trace(spark, GAPS)
    assert values(impute.hold_leading(t))[:4] == [1, 1, 1, None]
    assert values(impute.linear_then_zero(t)) == [0, 0, 1, 2, 3, 4, 5, 6, 7, 0, 0, 0, 0, 5, 5]
    assert values(impute.nearest_fill(t)) == [1, 1, 1, 1, 3, 3, 3, 7, 7, 0, 0, 0, 0, 5, 5]
    assert values(impute.constant_fill(t, 2)) == [-1, -1, 1, -1, 3, N, N, N, 7, 0, 0, 0, 0, 5, -1]


@pytest.mark.parametrize("z,kept", [(2, 0), (3, 1), (4, 0), (5, 4)])
def test_zero_runs_in_chunks(spark, z, kept):
    got = values(impute.zeros_to_null(trace(spark, GAPS), z))
    assert got[9:13] == [N] * (4 - kept) + [0.0] * kept


def test_zero_run_at_the_end_counts_one_less(spark):
    assert values(impute.zeros_to_null(trace(spark, [1, 0, 0, 0]), 3)) == [1, 0, 0, 0]
    assert values(impute.zeros_to_null(trace(spark, [1, 0, 0, 0]), 3, mode="run")) == [1, N, N, N]


def test_gap_histogram(spark):
    got = {(r.kind, r.run_len): r.n for r in impute.gap_histogram(trace(spark, GAPS)).collect()}
    assert got == {("null", 2): 1, ("null", 1): 2, ("null", 3): 1, ("zero", 4): 1}


def test_moving_average_voids_nulls(spark):
    got = impute.moving_average(trace(spark, [1, 2, 3, 4, N, 6, 7, 8]), 3).orderBy("pos").collect()
    assert [(r.pos, r.mean) for r in got] == [(2, 2.0), (3, 3.0), (7, 7.0)]


def test_elapsed(spark):
    got = impute.elapsed_since_seen(trace(spark, [N, N, 5, N, N, N, 1])).orderBy("pos").collect()
    assert [r.elapsed for r in got] == [1, 2, 1, 2, 3, 4, 1]


def records(spark, minutes, sid):
    t0 = dt.datetime(2024, 1, 2)
    return [(sid, t0 + dt.timedelta(minutes=m, seconds=i), i, 1.0) for i, m in enumerate(minutes)]


def test_collisions(spark):
    rows = records(spark, [10, 10, 10, 9, 5], 1) + records(spark, [10, 10, 1], 2)
    df = spark.createDataFrame(rows, "series_id INT, ts TIMESTAMP, event_id INT, value DOUBLE")
    out = grid.backfill_collisions(df, "1 minute", tie="event_id").collect()
    base = min(r.bin for r in out) - 1
    got = {s: sorted((r.slot - base for r in out if r.series_id == s), reverse=True) for s in (1, 2)}
    assert got == {1: [10, 9, 8, 7, 5], 2: [10, 9, 1]}
    assert all(r.slot <= r.bin for r in out)


def test_common_grid_gives_silent_animals_a_trace(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 5), 2.0)], "series_id INT, ts TIMESTAMP, value DOUBLE")
    ids = spark.createDataFrame([(1,), (9,)], "series_id INT")
    out = grid.common_grid(df, "1 hour", ids=ids)
    assert {r.series_id: (r.n, r.c) for r in out.groupBy("series_id").agg(F.count("*").alias("n"), F.count("value").alias("c")).collect()} == {
        1: (25, 1),
        9: (25, 0),
    }


def test_blocks_round_trip(spark):
    t = trace(spark, GAPS)
    assert values(grid.from_blocks(grid.to_blocks(t, 4), 4)) == values(t)
    padded = grid.to_blocks(t, 4, pad=True).orderBy("block").collect()
    assert [len(r["values"]) for r in padded] == [4] * 4
    assert padded[-1]["values"] == [0.0, 5.0, None, None]


def test_rollups_agree_with_single_resolution(spark):
    rows = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=17 * i), float(i), i % 5, i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "series_id INT, ts TIMESTAMP, value DOUBLE, signal_strength INT, battery_voltage INT")
    cols = ["series_id", "bucket", "value", "signal_min", "signal_max", "first_ts"]
    every = grid.rollups(df)
    for name in grid.RESOLUTIONS:
        a = every.filter(F.col("resolution") == name).select(*cols).collect()
        assert sorted(a) == sorted(grid.resample(df, name).select(*cols).collect())


def visits(spark):
    days = [0, 7, 14, 21, 40, 41]
    scores = [1, 1, 2, 2, 1, 5]
    d0 = dt.date(2024, 1, 1)
    rows = [(1, i, d0 + dt.timedelta(days=d), s) for i, (d, s) in enumerate(zip(days, scores))]
    return spark.createDataFrame(rows, "series_id INT, visit_id LONG, visit_date DATE, score INT")


def test_visit_sequences(spark):
    v = visits(spark)
    prev = labels.previous_scores(v).orderBy("visit_id").collect()
    assert [r.label for r in prev] == [None, "1To1", "1To2", "2To2", "2To1", "1To5"]
    assert prev[5].prev4 == 1
    gaps = labels.next_visits(v).orderBy("visit_id").first()
    assert (gaps.gap1, gaps.gap2, gaps.gap3, gaps.gap4) == (7, 7, 7, 19)
    assert labels.minimum_gap(v).first().min_gap == 1
    assert [r.consecutive for r in labels.consecutive_mask(v).orderBy("visit_id").collect()] == [True, True, True, False, False, False]
    assert [r.change for r in labels.change_flags(v).orderBy("visit_id").collect()] == [None, 4, 1, 3, 2, 1]
    assert [r.half for r in labels.halves(v).orderBy("visit_id").collect()] == [1, 1, 1, 2, 2, 2]


def test_labelled_samples(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(hours=h), None if h % 5 == 0 else float(h), 1 if 24 <= h < 49 else 0) for h in range(100)]
    tr = spark.createDataFrame(rows, "series_id INT, ts TIMESTAMP, value DOUBLE, imputed INT")
    vs = [(1, 1, t0 + dt.timedelta(hours=30), 1), (1, 2, t0 + dt.timedelta(hours=72, minutes=20), 2), (1, 3, t0 + dt.timedelta(hours=200), 3)]
    v = spark.createDataFrame(vs, "series_id INT, visit_id LONG, visit_ts TIMESTAMP, score INT")
    out = samples.labelled_samples(tr, v, "1 hour", 2).collect()
    assert [(r.sample_id, r.label, r.cells, r.imputed_days, r.valid) for r in out] == [(2, "1To2", 48, 1, True)]
    assert out[0].features == [None if h % 5 == 0 else float(h) for h in range(25, 73)]


def test_filters_on_arrays(spark):
    df = spark.createDataFrame([(1, [None, None]), (2, [1.0, None]), (3, [-1.0, 2.0])], "sample_id INT, features ARRAY<DOUBLE>")
    assert [r.sample_id for r in filters.not_all_null(df).orderBy("sample_id").collect()] == [2, 3]
    assert [r.sample_id for r in filters.no_nulls(df).collect()] == [3]
    assert df.filter("sample_id = 3").select(filters.clip_negative().alias("f")).first().f == [0.0, 2.0]
