"""Answers that depend on data the given tables do not hold."""

import json
import math

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracelab.operators.evaluate import normal_tail
from tracelab.sources import tables


def test_a_series_in_two_farms_is_rolled_up_in_each(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:05", 1.0, 10.0, 5.0, "a"), (1, "2024-01-01 00:00:06", 2.0, 10.0, 5.0, "b")]
    df = spark.createDataFrame(rows, "series_id long, ts string, value double, signal_strength double, battery_voltage double, farm_id string")
    tables.write_rollups(df.withColumn("ts", F.col("ts").cast("timestamp")), str(tmp_path / "out"), ["day"])
    got = spark.read.parquet(str(tmp_path / "out")).select("farm_id", "series_id", "value").collect()
    assert sorted(map(tuple, got)) == [("a", 1, 1.0), ("b", 1, 2.0)]


def test_repeated_readings_are_exported_alike_however_they_lie(spark):
    rows = [(1, 10, 3.0), (1, 10, 1.0), (1, 11, 2.0)]
    for parts in (1, 3):
        df = spark.createDataFrame(rows[::-1] if parts == 3 else rows, "series_id long, ts long, value double").repartition(parts)
        assert sorted((r.ts, r.value) for r in tables.long_export(df, ["series_id", "ts"], ["value"]).collect()) == [(10, 1.0), (11, 2.0)]
        assert [tuple(r) for r in tables.wide_export(df, [1]).collect()] == [(10, 1.0), (11, 2.0)]


def test_results_over_several_lines(spark, tmp_path):
    place = tmp_path / "farm=x" / "runs"
    place.mkdir(parents=True)
    (place / "one.json").write_text(json.dumps({"fold": 1, "auc": 0.5}, indent=2))
    (place / "two.json").write_text(json.dumps([{"fold": 2, "auc": 0.75}, {"fold": 3, "auc": 1.0}], indent=2))
    got = tables.read_results(spark, str(tmp_path), "fold INT, auc DOUBLE", {"farm": r"/farm=([^/]+)/"}, lines=False).collect()
    assert sorted(map(tuple, got)) == [(1, 0.5, "x"), (2, 0.75, "x"), (3, 1.0, "x")]


def test_tail_is_right_in_relation_to_its_size(spark):
    zs = [0.0, 0.1, 1.0, 2.5, 2.999, 3.0, 3.5, 6.0, 12.0, 30.0]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(normal_tail(F.col("z")).alias("p")).collect()]
    for z, p in zip(zs, got, strict=True):
        assert math.isclose(p, math.erfc(z / math.sqrt(2)) / 2, rel_tol=1e-9), z


def test_values_that_the_given_tables_do_not_hold_are_kept(spark, tmp_path):
    sf, odd = "/root/testdata/sf0.001", str(tmp_path)
    key = F.col("o_orderkey") % 7
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_orderstatus", F.when(key == 0, "X").when(key != 1, F.col("o_orderstatus")))
    orders.write.parquet(f"{odd}/orders.parquet")
    key = F.col("l_orderkey") % 7
    swap = lambda c: F.when(key == 0, "X").when(key != 1, F.col(c)).alias(c)
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    items = items.select(*[swap(c) if c in ("l_linestatus", "l_returnflag") else c for c in items.columns])
    items = items.withColumn("l_linenumber", F.when(key == 2, 8).otherwise(F.col("l_linenumber")).cast(items.schema["l_linenumber"].dataType))
    items.write.parquet(f"{odd}/lineitem.parquet")
    run = lambda name: entry.queries()[name](spark, odd).collect()

    got = run("g1_union_of_sources")
    assert len(got) == orders.count() and {r.source for r in got} == {"f", "o", "p", "x", None}
    got = run("a15_merged_results")
    assert sum(r.n for r in got) == items.count() and {r.method for r in got} == {"F", "O", "X", None}
    got = run("m7_cross_farm_split")
    assert {r.direction for r in got} == {"A", "N", "R", "X"} and sum(r.n for r in got) == 4 * items.count()
    assert all((r.split == "train") == (r.farm_id == r.direction) for r in got) and None in {r.farm_id for r in got}
    got = run("m20_metric_pivot")
    assert {r.method for r in got} == {"F", "O", "X", None} and all(list(r.asDict()) == ["method", *[f"fold_{i}" for i in range(1, 9)]] for r in got)
    assert any(r.fold_8 is not None for r in got)
