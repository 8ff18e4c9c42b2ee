"""Bucketed ordered scans give what a plain window over the whole key gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelab.functions.scan import neighbours, ranked, runs, scan, with_halo


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = []
    for k, n in ((1, 60), (2, 1), (3, 7), (4, 200)):
        for i, t in enumerate(sorted(rnd.sample(range(400), n))):
            data.append((k, t, i, None if rnd.random() < 0.4 else rnd.random()))
    return spark.createDataFrame(data, "k INT, t INT, i INT, v DOUBLE").cache()


def same(a, b):
    key = lambda r: tuple(str(x) for x in r)
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


@pytest.mark.parametrize("width", [1, 3, 50, 1000])
def test_neighbours(rows, width):
    w = Window.partitionBy("k").orderBy("t")
    got = neighbours(
        rows, ["k"], ["t"], F.floor(F.col("t") / width), {"a": (F.col("v"), 1), "b": (F.col("t"), 3), "c": (F.col("v"), -2)}
    )
    want = rows.withColumns({"a": F.lag("v", 1).over(w), "b": F.lag("t", 3).over(w), "c": F.lead("v", 2).over(w)})
    same(got, want)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_scan(rows, width):
    w = Window.partitionBy("k").orderBy("t")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    got = scan(
        rows,
        ["k"],
        ["t"],
        F.floor(F.col("t") / width),
        last={"l": F.col("v")},
        prior={"p": F.col("v")},
        following={"n": F.col("v")},
        cumsum={"s": F.col("i")},
        cummin={"m": F.col("v")},
        whole={"w": ("max", F.col("i"))},
    )
    want = rows.withColumns(
        {
            "l": F.last("v", True).over(up),
            "p": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "n": F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
            "s": F.sum("i").over(up),
            "m": F.min("v").over(up),
            "w": F.max("i").over(Window.partitionBy("k")),
        }
    )
    same(got.select(*want.columns), want)


def test_ranked(rows):
    got = ranked(rows, ["k"], ["t"], F.floor(F.col("t") / 9)).select("k", "t", "rn")
    want = rows.select("k", "t", F.row_number().over(Window.partitionBy("k").orderBy("t")).cast("long").alias("rn"))
    same(got, want)


def test_runs_cross_blocks(spark):
    flags = [0, 0, 1, 1, 1, 1, 1, 0, 1, 1, 0, 0]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "k INT, pos LONG, f INT")
    got = runs(df, ["k"], "pos", F.col("f") == 1, 3).orderBy("pos").collect()
    assert [r.run_len for r in got] == [2, 2, 5, 5, 5, 5, 5, 1, 2, 2, 2, 2]
    assert [r.run_start for r in got][2:7] == [2] * 5


def test_halo_holds_every_preceding_row(spark):
    df = spark.range(25).select(F.lit(1).alias("k"), F.col("id").alias("pos"))
    got = with_halo(df, "pos", 4, 6)
    assert got.filter("home").count() == 25
    per = {r.block: {x.pos for x in got.filter(F.col("block") == r.block).collect()} for r in got.select("block").distinct().collect()}
    for p in range(25):
        assert set(range(max(0, p - 6), p + 1)) <= per[p // 4]
