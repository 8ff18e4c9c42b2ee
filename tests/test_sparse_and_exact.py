"""Run-length traces, bracketed quantiles, pivot neighbours, numbered combinations, window sums and exact tests against plain Python."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.functions.quantile import medians, quantiles, with_medians
from tracelab.operators import combinations, evaluate, filters, impute, joins, neighbours, runlength, sets, splits
from tracelab.session import scratch
from tracelab.sources import tables

SF = "/root/testdata/sf0.001"


# -- quantiles ---------------------------------------------------------------


@pytest.mark.parametrize("kind", ["even", "ties", "narrow", "two"])
def test_bracketed_quantiles(spark, kind):
    rng = random.Random(kind)
    draw = {
        "even": lambda: rng.uniform(-1e6, 1e6), "ties": lambda: float(rng.randint(0, 3)),
        "narrow": lambda: 5 + rng.random() * 1e-9, "two": lambda: rng.choice([1.0, 1e300]),
    }[kind]
    groups = {k: [draw() for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 3), ("d", 10), ("e", 4001), ("f", 20_000))}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("g", None), ("b", float("nan")), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = {"lo": 0.0, "p": 0.025, "m": 0.5, "q": 0.975, "hi": 1.0}
    got = {r.k: r for r in quantiles(df, ["k"], "v", probs).collect()}
    assert set(got) == {*groups, None}
    groups[None] = [3.0, 5.0]
    for k, values in groups.items():
        assert got[k].n == len(values)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), rel=1e-12), (k, name)
    one = quantiles(df, [], "v", {"m": 0.5}).collect()
    assert len(one) == 1 and one[0].m == pytest.approx(np.median([v for vs in groups.values() for v in vs]), rel=1e-12)
    assert quantiles(df.where("v > 1e308"), [], "v", {"m": 0.5}).count() == 0


def test_one_pass_for_several_medians(spark):
    rows = [(i % 3, float(i * 7 % 11), None if i % 4 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    got = with_medians(df.groupBy("k").agg(F.count("*").alias("n")), df, ["k"], {"ma": "a", "mb": F.col("b") * 2}).collect()
    for r in got:
        own = [x for x in rows if x[0] == r.k]
        assert r.ma == np.median([x[1] for x in own]) and r.mb == 2 * np.median([x[2] for x in own if x[2] is not None])


def test_only_brackets_are_shuffled(spark):
    """Values meet the brackets before any exchange; what leaves the tasks is counted per value inside and once per side."""
    df = spark.range(0, 400_000, 1, 8).select((F.col("id") % 2).alias("k"), F.rand(3).alias("v"))
    df = scratch(df, "plain").df
    out = medians(df, ["k"], "v")
    out.collect()
    text = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    below = text.rsplit("BroadcastHashJoin", 1)[1]  # the brackets are sent to the values, which stay where they are
    assert "hashpartitioning" not in below and "FileScan" in below


# -- run-length traces -------------------------------------------------------


def traces(spark, seed, default=None):
    rng = random.Random(seed)
    cells, spans = [], []
    for s in range(6):
        n = rng.choice([1, 5, 40, 3000])
        spans.append((s, 0, n - 1))
        for p in range(n):
            if rng.random() < 0.3 and not 900 < p < 2000:
                value = rng.choice([None, 0.0, float(rng.randint(1, 9))])
                if default is None or value != default:
                    cells.append((s, p, value))
    spans.append((6, 0, 9))  # a series without any cell
    known = {(s, p): v for s, p, v in cells}
    dense = [(s, p, known.get((s, p), default)) for s, _, last in spans for p in range(last + 1)]
    sparse = runlength.SparseTrace(
        spark.createDataFrame(cells, "series_id int, pos long, value double"), spark.createDataFrame(spans, "series_id int, first long, last long"), default
    )
    return sparse, spark.createDataFrame(dense, "series_id int, pos long, value double")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("default", [None, 0.0])
def test_runs_of_sparse_traces(spark, default, monkeypatch):
    monkeypatch.setattr(runlength, "BLOCK", 64)
    sparse, dense = traces(spark, 3, default)
    cols = ("series_id", "pos", "kind", "run_start", "run_end", "run_len")
    assert rows_of(runlength.cells_of_runs(runlength.null_runs(sparse)), *cols) == rows_of(impute.null_runs(dense), *cols)
    assert rows_of(runlength.cells_of_runs(runlength.zero_runs(sparse)), *cols) == rows_of(impute.zero_runs(dense), *cols)
    assert rows_of(runlength.gap_histogram(sparse), "kind", "run_len", "n") == rows_of(impute.gap_histogram(dense), "kind", "run_len", "n")
    for z in (1, 2, 5):
        for mode in ("chunked", "run"):
            got = runlength.zeros_to_null(sparse, z, mode=mode)
            assert rows_of(got, "series_id", "pos", "value") == rows_of(impute.zeros_to_null(dense, z, mode=mode), "series_id", "pos", "value")


@pytest.mark.parametrize("inclusive", [True, False])
def test_fill_of_sparse_traces(spark, inclusive, monkeypatch):
    monkeypatch.setattr(runlength, "BLOCK", 64)
    sparse, dense = traces(spark, 5)
    got = {(r.series_id, r.pos): r.value for r in runlength.bounded_interpolation(sparse, 4, inclusive=inclusive).collect()}
    want = {(r.series_id, r.pos): r.value for r in impute.bounded_interpolation(dense, 4, inclusive=inclusive).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v) if v is not None else got[k] is None for k, v in want.items())
    with pytest.raises(ValueError):
        runlength.gaps(traces(spark, 1, 0.0)[0])


def test_events_are_read_once(spark):
    from tracelab.plans.catalogue import QUERIES

    for name in ("e5_null_runs", "e6_gap_histogram", "t6_bounded_interpolation", "t8_zero_runs_to_null_chunked"):
        text = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "event_id" not in text and "props" not in text and "Relation [series_id" in text, name


# -- neighbours --------------------------------------------------------------


def clustered(n, folds, seed, kinds=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 50, (kinds, 6))
    points = centres[rng.integers(0, kinds, n)] + rng.normal(0, 1, (n, 6))
    points[5] = points[6] = points[7]  # ties
    return [(i * 3, int(rng.integers(0, 2)), int(rng.integers(0, folds)), points[i].tolist()) for i in range(n)]


def brute(rows, k):
    out = {}
    for i, _, fold, x in rows:
        others = [(sum((a - b) ** 2 for a, b in zip(x, z)), j, y) for j, y, g, z in rows if g != fold]
        out[i] = {j for _, j, _ in sorted(others)[: k if k is not None else math.isqrt(len(others))]}
    return out


@pytest.mark.parametrize(("k", "block_rows"), [(3, 4096), (7, 20), (None, 64)])
def test_pivot_neighbours(spark, k, block_rows):
    rows = clustered(300, 3, 2)
    df = spark.createDataFrame(rows, "sample_id long, y int, fold int, features array<double>")
    found = {}
    for r in neighbours.nearest(df, k, pivots=16, block_rows=block_rows).collect():
        found.setdefault(r.sample_id, set()).add(r.neighbour)
    assert found == brute(rows, k)


def test_most_cells_are_skipped(spark):
    rows = clustered(600, 2, 4, kinds=16)
    df = spark.createDataFrame(rows, "sample_id long, y int, fold int, features array<double>")
    placed, known = neighbours.cells(df, pivots=32)
    met = neighbours.routes(placed, known, 5).count()
    assert met < 0.4 * len(rows) * 32
    assert neighbours.nearest(df.limit(0), 3).count() == 0
    assert neighbours.nearest(df.where("fold = 0"), 3).count() == 0


# -- combinations ------------------------------------------------------------


@pytest.mark.parametrize(("m", "n"), [(7, 1), (7, 2), (9, 3), (8, 5)])
def test_numbers_are_combinations(spark, m, n):
    total = math.comb(m, n)
    got = spark.range(total).select("id", combinations.members(F.col("id"), m, n).alias("c")).collect()
    assert {tuple(r.c) for r in got} == set(itertools.combinations(range(m), n))
    assert all(sum(math.comb(c, k + 1) for k, c in enumerate(r.c)) == r.id for r in got)


def test_large_numbers(spark):
    m, n = 100_000, 3
    numbers = [0, 1, math.comb(m, n) - 1, 123_456_789_012_345]
    got = spark.createDataFrame([(x,) for x in numbers], "id long").select("id", combinations.members(F.col("id"), m, n).alias("c")).collect()
    assert all(sum(math.comb(c, k + 1) for k, c in enumerate(r.c)) == r.id and r.c == sorted(set(r.c)) for r in got)


@pytest.mark.parametrize(("total", "count"), [(10, 3), (10, 9), (10, 10), (10, 50), (1000, 999), (10**12, 500), (5, 0)])
def test_drawn_numbers(spark, total, count):
    got = [r.number for r in combinations.drawn_numbers(spark, total, count, 1).collect()]
    assert len(got) == len(set(got)) == min(total, count) and all(0 <= x < total for x in got)


# -- windows, wide tables, files ---------------------------------------------


@pytest.mark.parametrize(("days", "slot"), [(1, 86400), (3, 86400), (2, 3600)])
def test_window_sums(spark, days, slot):
    rng = random.Random(days)
    records = [(rng.randint(1, 4), rng.randint(0, 12 * 86400), float(rng.randint(1, 50))) for _ in range(300)] + [(9, 5, None)]
    stops = [(k, rng.randint(-2 * 86400, 15 * 86400)) for k in range(40)] + [(99, 86400 * 3)]
    df = spark.createDataFrame(records, "series_id int, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    samples = spark.createDataFrame(stops, "sample_id int, s long").select("sample_id", F.timestamp_seconds("s").alias("stop"))
    got = {(r.sample_id, r.series_id): (r.n, round(r.total, 6)) for r in joins.herd_window_sums(df, samples, days, slot=slot).collect()}
    want = {}
    for k, stop in stops:
        for s, t, v in records:
            if stop - days * 86400 < t <= stop:
                n, total = want.get((k, s), (0, 0.0))
                want[k, s] = (n + 1, total + (v or 0.0))
    assert got == want


def test_wide_traces(spark):
    rows = [(s, t, float(s * 100 + t)) for s in range(1, 11) for t in range(6) if (s + t) % 3] + [(99, 2, None)]
    df = spark.createDataFrame(rows, "series_id long, t long, value double").select("series_id", F.timestamp_seconds("t").alias("ts"), "value")
    wide, columns = joins.wide_traces(df, width=4)
    at = {(r.block, r.slot): r.series_id for r in columns.collect()}
    assert sorted(at.values()) == [*range(1, 11), 99] and max(b for b, _ in at) == 2
    seen = {(at[r.block, i], r.ts.timestamp()): v for r in wide.collect() for i, v in enumerate(r["values"]) if v is not None}
    assert seen == {(s, float(t)): v for s, t, v in rows if v is not None}
    times = spark.range(9).select(F.timestamp_seconds("id").alias("ts"))
    assert sorted(r.ts.timestamp() for r in joins.silent_times(wide, times).collect()) == [6.0, 7.0, 8.0]


def test_nested_result_files(spark, tmp_path):
    one = {"fold": 1, "metrics": {"auc": 0.5}, "y_test": [0, 1, 1]}
    (tmp_path / "run_a__7_qn").mkdir()
    (tmp_path / "run_b__14_std").mkdir()
    (tmp_path / "run_a__7_qn" / "f1.json").write_text(json.dumps(one, indent=4))
    (tmp_path / "run_a__7_qn" / "f2.json").write_text(json.dumps({"folds": [{**one, "fold": 2}, {"fold": 3, "metrics": {"auc": "n/a"}}]}, indent=2))
    (tmp_path / "run_b__14_std" / "all.json").write_text(json.dumps([{**one, "fold": 4}, {**one, "fold": 5, "y_test": []}]))
    fields = {"fold": ("$.fold", "int"), "auc": ("$.metrics.auc", "double"), "y": ("$.y_test", "array<int>")}
    got = tables.read_nested_results(spark, str(tmp_path), fields, {"run": r"run_(.+?)__", "days": r"__(\d+)_"}).collect()
    assert {(r.run, r.days, r.fold, r.auc, tuple(r.y) if r.y is not None else None) for r in got} == {
        ("a", "7", 1, 0.5, (0, 1, 1)), ("a", "7", 2, 0.5, (0, 1, 1)), ("a", "7", 3, None, None), ("b", "14", 4, 0.5, (0, 1, 1)), ("b", "14", 5, 0.5, ()),
    }


# -- bootstrap and exact ranks -----------------------------------------------


def test_replicates_at_once(spark):
    rng = random.Random(8)
    rows = [(i, f"f{i % 6}", rng.randint(0, 1), rng.randint(0, 12) / 4, rng.choice(["train", "test"]), rng.randint(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "sample_id long, fold string, y int, score double, split string, y_pred int")
    draws = {}
    for r in splits.resample_weights(df, "fold", 30, 3).collect():
        draws.setdefault(r.replicate, {})[r.fold] = r.times
    got = {r.replicate: r for r in evaluate.bootstrap_metrics(df, "fold", 30, 3, split="split").collect()}
    assert len(got) == 30
    for rep, times in draws.items():
        for side, name in (("test", "auc"), ("train", "train_auc")):
            pos = [(s, times.get(f, 0)) for _, f, y, s, part, _ in rows if y == 1 and part == side]
            neg = [(s, times.get(f, 0)) for _, f, y, s, part, _ in rows if y == 0 and part == side]
            won = sum(a * b * (1.0 if s > t else 0.5 if s == t else 0.0) for s, a in pos for t, b in neg)
            pairs = sum(a for _, a in pos) * sum(b for _, b in neg)
            assert got[rep][name] == pytest.approx(won / pairs) if pairs else got[rep][name] is None
        flagged = [(y, times.get(f, 0)) for _, f, y, _, part, p in rows if p == 1 and part == "test"]
        total = sum(w for _, w in flagged)
        assert got[rep].precision == pytest.approx(sum(y * w for y, w in flagged) / total) if total else got[rep].precision is None


def test_exact_ranks(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 1), float(rng.randint(0, 4))) for k in range(12) for _ in range(rng.randint(2, 9))]
    rows += [(50, 1, 1.0), (51, 0, 1.0), (52, 1, None), (52, 0, 2.0)] + [(60, i % 2, float(i)) for i in range(60)]
    got = {r.k: r for r in evaluate.mann_whitney_exact(spark.createDataFrame(rows, "k int, y int, score double"), ["k"]).collect()}
    want = {}
    for k in range(12):
        own = sorted((s, y) for g, y, s in rows if g == k)
        values, n1 = [s for s, _ in own], sum(y for _, y in own)
        if not 0 < n1 < len(own):
            continue
        rank = [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]
        seen = sum(r for r, (_, y) in zip(rank, own) if y)
        sums = [sum(c) for c in itertools.combinations(rank, n1)]
        tail = min(sum(s <= seen for s in sums), sum(s >= seen for s in sums)) / len(sums)
        want[k] = (seen - n1 * (n1 + 1) / 2, min(1.0, 2 * tail))
    assert got.keys() == want.keys()
    assert all((got[k].u, got[k].p) == pytest.approx(v) for k, v in want.items())


# -- smaller ones ------------------------------------------------------------


def test_active_windows_and_union(spark):
    cells = [(1, p, float(p % 5 == 0)) for p in range(20)] + [(2, p, 0.0) for p in range(20)] + [(3, p, None) for p in range(20)]
    df = spark.createDataFrame(cells, "series_id int, pos long, value double")
    assert {(r.series_id, r.window) for r in filters.active_windows(df, 10, 1).collect()} == {(1, 0), (1, 1)}
    assert filters.active_windows(df, 10, 2).count() == 0
    a, b = spark.createDataFrame([(1, "x")], "i int, t string"), spark.createDataFrame([("y", 2)], "t string, i int")
    assert {tuple(r) for r in sets.union_sources({"a": a, "b": b}).select("source", "i", "t").collect()} == {("a", 1, "x"), ("b", 2, "y")}


def test_long_series_in_blocks(spark):
    from tracelab.operators import spectral

    rng = np.random.default_rng(3)
    lengths = {1: 1, 2: 90, 3: 700}
    values = {s: rng.normal(0, 1, n) for s, n in lengths.items()}
    df = spark.createDataFrame([(s, p, float(v)) for s, vs in values.items() for p, v in enumerate(vs)], "series_id long, pos long, value double")
    kernels = [spectral.morlet_kernel(s) for s in (1.5, 6.0)]
    for block in (32, 5000):
        got = {(r.series_id, r.scale, r.pos): r.x for r in spectral.long_magnitude(df, kernels, block=block).collect()}
        assert len(got) == 2 * sum(lengths.values())
        for s, vs in values.items():
            for n, kernel in enumerate(kernels):
                want = np.abs(np.convolve(vs, kernel))[len(kernel) // 2 :][: len(vs)]
                assert np.allclose([got[s, n, p] for p in range(len(vs))], want, atol=1e-10)


def test_middle_row_of_a_hot_table(spark):
    from tracelab.operators import stats

    for n in (1, 2, 3, 10, 5001):
        df = spark.range(n).select((F.col("id") % 2).alias("k"), (F.col("id") * 7 + 3).alias("o"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("d"))
        got = stats.dataset_span(df, key="k", date="d", order="o").first()
        rows = df.orderBy("o").collect()
        assert (got.n, got.first_date, got.middle_date, got.last_date) == (n, rows[0].d, rows[n // 2].d, rows[-1].d)
