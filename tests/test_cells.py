"""Quantiles, normalisation, transforms and spectra against numpy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelab.functions import scalar
from tracelab.functions.quantile import array_median, quantiles
from tracelab.operators import normalise, samples, spectral

QN = [[12, 5, 0, 9, 3], [7, 0, 14, 2, 6], [0, 11, 8, 21, 1], [30, 4, 2, 0, 17], [9, 13, 6, 10, 0]]
SOME = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def table(spark, rows):
    data = [(i, [None if v is None else float(v) for v in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "sample_id LONG, features ARRAY<DOUBLE>")


def matrix(df):
    return np.array([r.features for r in df.orderBy("sample_id").collect()], dtype=float)


@SOME
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(1, v) for v in values] + [(1, None), (1, float("nan"))], "k INT, v DOUBLE")
    r = quantiles(df, ["k"], "v", {"a": 0.025, "b": 0.5, "c": 0.9}).first()
    assert r.n == len(values)
    np.testing.assert_allclose([r.a, r.b, r.c], np.quantile(values, [0.025, 0.5, 0.9]), rtol=1e-9, atol=1e-9)


def test_array_median(spark):
    df = table(spark, [[3, None, 1], [None, None], [4, 1, 2, 3]])
    got = [r.m for r in df.withColumn("m", array_median(F.col("features"))).orderBy("sample_id").collect()]
    assert got == [2.0, None, 2.5]


def qn_numpy(x):
    med = np.median(x, axis=0)
    med[med <= 0] = 1
    ratio = x / med
    ratio[ratio <= 0] = np.nan
    return x / np.nanmedian(ratio, axis=1)[:, None]


def test_quotient(spark):
    x = np.array(QN, dtype=float)
    np.testing.assert_allclose(matrix(normalise.quotient(table(spark, QN))), qn_numpy(x))


def test_scalers(spark):
    x = np.array(QN, dtype=float)
    df = table(spark, QN)
    np.testing.assert_allclose(matrix(normalise.standard_scale(df)), (x - x.mean(0)) / x.std(0))
    np.testing.assert_allclose(matrix(normalise.min_max(df)), (x - x.min(0)) / (x.max(0) - x.min(0)))
    np.testing.assert_allclose(matrix(normalise.l2(df)), x / np.linalg.norm(x, axis=1)[:, None])
    np.testing.assert_allclose(matrix(normalise.centre(df)), x - x.mean())
    steps = normalise.apply_steps(df, ["L2", "APPEND", "SQRT"])
    np.testing.assert_allclose(matrix(steps), np.hstack([x / np.linalg.norm(x, axis=1)[:, None], np.sqrt(x)]))


def test_empty_position_stays_aligned(spark):
    df = table(spark, [[1, None, 3], [2, None, 5]])
    got = [r.features for r in normalise.quotient(df).orderBy("sample_id").collect()]
    assert got[0][1] == 0.0 and all(v is not None for v in got[0])


def test_unknown_step_raises(spark):
    with pytest.raises(ValueError, match="unknown steps"):
        normalise.apply_steps(table(spark, QN), ["L2", "NOPE"])


@SOME
@given(st.lists(st.integers(0, 480), min_size=1, max_size=20))
def test_anscombe_round_trip(spark, counts):
    df = spark.createDataFrame([(float(c),) for c in counts], "v DOUBLE")
    back = scalar.inverse_anscombe(scalar.anscombe(F.col("v")), method="asym")
    for r in df.select("v", back.alias("b")).collect():
        assert abs(r.v - r.b - (-0.25)) < 1e-9 or abs(r.v - r.b) < 0.26


def test_differences_and_windows(spark):
    df = table(spark, [list(range(12))])
    assert matrix(normalise.day_difference(df, 4)).tolist() == [[4.0] * 8]
    assert matrix(normalise.last_day_difference(df, 4)).tolist() == [[-8.0] * 4 + [-4.0] * 4]
    assert [r.start for r in samples.rolling_windows(df, 5, 3).orderBy("start").collect()] == [0, 3, 6]
    assert samples.rolling_windows(table(spark, [[1, 2]]), 5, 3).count() == 0
    assert matrix(df.withColumn("features", samples.sum_bins(5))).tolist() == [[10.0, 35.0, 21.0]]


@pytest.mark.parametrize("wavelet", ["haar", "db4", "coif1"])
@pytest.mark.parametrize("n", [64, 50, 33])
def test_denoise_without_threshold_rebuilds(spark, wavelet, n):
    x = np.random.default_rng(1).normal(size=(2, n))
    got = matrix(spectral.denoise(table(spark, x), 0.0, wavelet, levels=2))
    np.testing.assert_allclose(got, x, atol=1e-9)


def test_fourier_resample_keeps_a_sine(spark):
    t = np.arange(35)
    x = np.sin(2 * np.pi * t / 35)
    got = matrix(spectral.fourier_resample(table(spark, [x])))[0]
    np.testing.assert_allclose(got, np.sin(2 * np.pi * np.arange(50) / 50), atol=1e-9)


def test_stft_peak(spark):
    x = np.sin(2 * np.pi * np.arange(64) / 8)
    power = matrix(spectral.stft_power(table(spark, [x]), 16))[0].reshape(9, -1)
    assert power.shape[1] == spectral.stft_frames(64, 16)
    assert power[:, 4].argmax() == 2


def test_peak_filter_agrees_with_positions(spark):
    kept = {(64, 16): [7, 8, 23, 24, 39, 40, 55, 56], (60, 20): [9, 10, 29, 30, 49, 50], (20, 240): [9, 10, 11]}
    for (width, span), want in kept.items():
        x = [1.0] * width
        got = normalise.peak_filter(table(spark, [x]), span).first().features
        assert [i for i, v in enumerate(got) if v is not None] == want
