"""Windows, filled roll-ups, medians of small groups and files per series: what moves follows the input."""

import datetime as dt
import glob
import random
import statistics

from pyspark.sql import functions as F

from tests.test_large_tables import joined  # noqa: F401
from tracelab.functions import quantile
from tracelab.operators import grid, samples
from tracelab.sources import tables

START = dt.datetime(2024, 1, 1)


def _trace(spark, hours):
    rows = [(s, START + dt.timedelta(hours=h), None if h % 7 else float(h), int(h % 24 < 20)) for s, h in hours]
    return spark.createDataFrame(rows, "series_id long, ts timestamp, value double, imputed int")


def test_windows_meet_stretches_not_cells(spark, joined):  # noqa: F811
    rng = random.Random(3)
    hours = [(s, h) for s in (1, 2) for h in range(240) if s == 1 or rng.random() < 0.9]
    visits = [(1 + i % 2, i, START + dt.timedelta(hours=rng.randint(0, 260), minutes=5), 1 + i % 5) for i in range(30)]
    visits += [(1, None, START + dt.timedelta(hours=100), 2), (2, 7, START + dt.timedelta(hours=101), 3), (1, 50, START + dt.timedelta(hours=100), 4), (1, 50, START + dt.timedelta(hours=600), 4)]
    v = spark.createDataFrame(visits, "series_id long, visit_id long, visit_ts timestamp, score int")
    trace = _trace(spark, hours)
    got = sorted((r.series_id, r.visit_id if r.visit_id is not None else -1, r.ts, r.pos) for r in samples.sample_cells(trace, v, "1 hour", 2).collect())
    want = []
    for s, i, at, _ in visits:
        stop = at.replace(minute=0)
        for t, h in hours:
            ts = START + dt.timedelta(hours=h)
            if t == s and stop - dt.timedelta(days=2) < ts <= stop:
                want.append((s, i if i is not None else -1, ts, 47 - int((stop - ts).total_seconds() // 3600)))
    assert got == sorted(want)
    out = {r.sample_id: r for r in samples.labelled_samples(trace, v, "1 hour", 2).collect()}
    cells = {}
    for s, i, ts, pos in want:
        cells.setdefault(i, []).append((pos, s, ts))
    whole = {i for i, c in cells.items() if len(c) == 48 and i != -1}
    ordered = sorted(visits, key=lambda r: (r[0], r[2]))
    first = {min((r for r in ordered if r[0] == s), key=lambda r: r[2])[1] for s in (1, 2)}
    assert set(out) == whole - first
    assert 50 in out and 7 not in out
    for i, r in out.items():
        hour = [int((ts - START).total_seconds() // 3600) for _, _, ts in sorted(cells[i])]
        assert r.features == [None if h % 7 else float(h) for h in hour] and r.cells == 48 and r.seen == sum(h % 7 == 0 for h in hour)
        assert r.imputed_days == sum(all(h % 24 < 20 for h in hour[d : d + 24]) for d in (0, 24)) and r.complete_days == 0
    assert max(x.count() for pair in joined for x in pair) < 100  # the trace has some 450 cells


def test_filled_rollup_moves_stretches(spark, joined):  # noqa: F811
    at = [(s, START + dt.timedelta(minutes=m), 1.5, 3, 4) for s, m in [(1, 0), (1, 7), (1, 2003), (2, 61), (2, 61 + 1430), (None, 5)]] + [(3, None, 1.0, 1, 1)]
    df = spark.createDataFrame(at, "series_id long, ts timestamp, value double, signal_strength int, battery_voltage int")
    out = grid.resample_from_first_filled(df, "10 minutes")
    got = {(r.series_id, r.bucket_s): r.value for r in out.collect()}
    s0 = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    want = {(1, s0 + 600 * k): {0: 3.0, 200: 1.5}.get(k) for k in range(201)} | {(2, s0 + 3660 + 600 * k): 1.5 if k in (0, 143) else None for k in range(144)}
    assert got == want and out.count() == len(want)
    assert max(x.count() for pair in joined for x in pair) < 100  # there are 345 steps


def test_small_groups_need_no_sketch(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k if k else None, round(rng.uniform(-5, 5), 2)) for k in range(40) for _ in range(1 + k % 9)] + [(99, None), (99, float("nan"))]
    df = spark.createDataFrame(rows, "k long, x double")
    groups = {}
    for k, x in rows[:-2]:
        groups.setdefault(k, []).append(x)
    want = {k: (len(x), round(statistics.median(x), 9), sorted(x)[len(x) // 2]) for k, x in groups.items()}

    def found():
        mid = {r.k: r.middle for r in quantile.middle_value(df, ["k"], "x").collect()}
        return {r.k: (r.n, round(r.m, 9), mid[r.k]) for r in quantile.quantiles(df, ["k"], "x", {"m": 0.5}).collect()}

    monkeypatch.setattr(quantile, "FEW", 4)  # some groups by arrays, some by brackets
    assert found() == want
    monkeypatch.setattr(quantile, "FEW", 4096)
    monkeypatch.setattr(quantile, "_bracketed", None)
    assert found() == want


def test_files_per_series_are_written_by_several_tasks(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 40).alias("series_id"), "id", F.lit(1.0).alias("value"))
    tables.write_per_series(df, str(tmp_path / "out"), {"value": "activity"})
    parts = {p.rsplit("/", 1)[1].split("-")[1] for p in glob.glob(f"{tmp_path}/out/series_id=*/part-*")}
    assert len(parts) > 1
    back = spark.read.schema("id long, activity double, series_id long").option("header", True).csv(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted((i, 1.0, i % 40) for i in range(200))
