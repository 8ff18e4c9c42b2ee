"""Physical plans: pushdown, no nested loops, no Python where expressions do."""

import pytest

from tracelab.operators.normalise import apply_steps
from tracelab.plans.catalogue import QUERIES
from tracelab.plans.sample_queries import samples

SF = "/root/testdata/sf0.001"
PYTHON = ("s1", "s2", "s3", "s4", "s5", "s6", "s7", "s9", "s10", "m10_near", "m21_exact")
EAGER = ("a1_", "a2_", "a3", "a4", "a5", "a6", "a7", "a8", "a9", "a10", "a13", "a14", "a15", "t18", "m10", "m23", "s8", "m16_bootstrap_interval", "n4")


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(EAGER)))
def test_no_nested_loops_and_no_stray_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if not name.startswith(PYTHON):
        assert "EvalPython" not in text and "InPandas" not in text


def test_filters_reach_the_scan(spark):
    for name in ("b1_plausible_range", "b2_station_and_year", "b3_time_slice"):
        text = plan(spark, name)
        pushed = text.split("PushedFilters: [")[1].split("]")[0]
        assert pushed, (name, text)


def test_scan_reads_only_needed_columns(spark):
    schema = plan(spark, "d25_activity_ranking").split("ReadSchema: struct<")[1].split(">")[0]
    assert schema == "user_id:bigint,value:double"


def test_zoom_prunes_partitions(spark):
    text = plan(spark, "t18_zoom")
    assert "PartitionFilters: [isnotnull(resolution" in text and "= 10 minutes" in text


def test_plans_grow_by_one_scan_with_each_fit(spark):
    data = samples(spark, SF)
    scans = []
    for n in range(1, 5):
        steps = ["STANDARDSCALER", "MINMAX", "CENTER", "QN"][:n]
        scans.append(apply_steps(data, steps)._jdf.queryExecution().optimizedPlan().toString().count("parquet"))
    assert all(b - a <= 1 for a, b in zip(scans, scans[1:])), scans


def test_interval_join_is_an_equi_join(spark):
    text = plan(spark, "c1_interval_join")
    assert "HashJoin" in text or "SortMergeJoin" in text
