"""Registered queries against DuckDB: a selection by default, all with TRACELAB_ALL=1."""

import os

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
FEW = {
    "a4_score_files", "b18_good_windows", "c6_exogenous_window", "c10_event_at_time", "d1_herd_mean_and_median",
    "d3_all_resolutions", "d7_class_counts", "e7_consecutive_mask", "e14_series_windows", "f2_top_per_farm", "g5_two_branches",
    "i7_elapsed", "m1_labelled_samples", "m4_individual_bootstrap", "m12_roc_curve", "m16_bootstrap_interval", "n3_quotient_residual",
    "s3_cone_of_influence", "t3_collision_backfill", "t16_bootstrap_error",
}
ALL = bool(os.environ.get("TRACELAB_ALL"))
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if ALL or n in FEW))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, entry.queries()[name], SQL.get(name), SF)
    assert ok, message


def test_selection_exists():
    assert FEW <= set(SQL)
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "label" in df.columns
