"""Metrics, splits and neighbours against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.operators import evaluate, models, splits


def preds(spark, y, score, fold=None):
    rows = [(i, fold[i] if fold else "f", a, float(s)) for i, (a, s) in enumerate(zip(y, score))]
    return spark.createDataFrame(rows, "sample_id LONG, fold STRING, y INT, score DOUBLE")


def brute_auc(y, s):
    pairs = [(a, b) for (ya, a), (yb, b) in itertools.product(zip(y, s), zip(y, s)) if ya == 1 and yb == 0]
    return sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)


def test_auc_with_ties(spark):
    y, s = [0, 0, 1, 1, 1], [0.1, 0.5, 0.5, 0.5, 0.9]
    assert evaluate.auc(preds(spark, y, s), ["fold"]).first().auc == pytest.approx(5 / 6)


def test_auc_random_and_mirrored(spark):
    rnd = random.Random(5)
    y = [rnd.randint(0, 1) for _ in range(80)]
    s = [rnd.randint(-20, 20) / 7 for _ in range(80)]
    a = evaluate.auc(preds(spark, y, s), []).first().auc
    b = evaluate.auc(preds(spark, y, [-v for v in s]), []).first().auc
    assert a == pytest.approx(brute_auc(y, s)) and a + b == pytest.approx(1)


def test_one_class_fold_has_no_auc(spark):
    df = preds(spark, [1, 1, 0, 1], [0.1, 0.2, 0.3, 0.4], ["a", "a", "b", "b"])
    got = {r.fold: r.auc for r in evaluate.auc(df, ["fold"]).collect()}
    assert got == {"a": None, "b": 1.0}
    assert evaluate.roc_curve(df, ["fold"]).filter("fold = 'a' and fpr is not null").count() == 0


def test_interpolated_roc_matches_numpy(spark):
    rnd = random.Random(9)
    y = [rnd.randint(0, 1) for _ in range(60)]
    s = [rnd.randint(0, 15) for _ in range(60)]
    thresholds = sorted(set(s), reverse=True)
    fpr = [0.0] + [sum(1 for a, v in zip(y, s) if v >= t and a == 0) / y.count(0) for t in thresholds]
    tpr = [0.0] + [sum(1 for a, v in zip(y, s) if v >= t and a == 1) / y.count(1) for t in thresholds]
    want = np.interp(np.linspace(0, 1, 100), fpr, tpr)
    want[0] = 0
    got = [r.tpr for r in evaluate.interpolated_roc(preds(spark, y, s), "fold").orderBy("i").collect()]
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_confusion(spark):
    df = preds(spark, [1, 1, 0, 0, 0], [0] * 5).withColumn("y_pred", F.when(F.col("sample_id").isin(0, 2), 1).otherwise(0))
    r = evaluate.confusion(df, []).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 1, 2, 1)
    assert r.f1_1 == pytest.approx(0.5) and r.balanced_accuracy == pytest.approx((0.5 + 2 / 3) / 2)


def test_folds_partition_samples(spark):
    df = spark.range(103).select(F.col("id").alias("sample_id"), (F.col("id") % 3).alias("label"))
    folds = splits.kfold(df, 5, repeats=2, seed=1, stratify="label").cache()
    assert folds.count() == 206 and folds.select("repeat", "sample_id").distinct().count() == 206
    sizes = [r["count"] for r in folds.join(df, "sample_id").groupBy("repeat", "label", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_leave_two_out_matches_combinations(spark):
    rnd = random.Random(2)
    rows = [(s, rnd.randint(0, 1)) for s in range(7) for _ in range(rnd.randint(1, 3))]
    df = spark.createDataFrame(rows, "series_id LONG, target INT")
    got = {(r.a, r.b) for r in splits.leave_two_out(df, stratified=True).collect()}
    classes = {s: {t for k, t in rows if k == s} for s in range(7)}
    want = set()
    for a, b in itertools.combinations(range(7), 2):
        rest = {t for k, t in rows if k not in (a, b)}
        if len(rest) == 2 and len(classes[a]) == 1 and len(classes[b]) == 1 and classes[a] != classes[b]:
            want.add((a, b))
    assert got == want
    only = spark.createDataFrame([(0,), (2,)], "series_id LONG")
    some = splits.leave_n_out(df, 3, only=only).select("members").collect()
    assert some and all(r.members[0] in (0, 2) and len(set(r.members)) == 3 for r in some)
    assert splits.leave_n_out(df, 3, cap=4).count() == 4
    every = {tuple(r.members) for r in splits.leave_n_out(df, 3).collect()}
    drawn = {tuple(r.members) for r in splits.leave_n_out(df, 3, drawn=4).collect()}
    assert 1 <= len(drawn) <= 4 and drawn <= every  # of four drawn, those with both classes left to train on
    assert {tuple(r.members) for r in splits.leave_n_out(df, 3, drawn=1000).collect()} == every
    assert splits.leave_n_out(df, 3, cap=1000).count() == len(every)


def test_bootstrap_draws(spark):
    ids = spark.range(12).select(F.col("id").alias("series_id"))
    rows = splits.individual_bootstrap(ids, 20, 1).collect()
    train, drawn = {}, {}
    for r in rows:
        if r.split == "train":
            train.setdefault(r.replicate, set()).add(r.series_id)
            drawn[r.replicate] = drawn.get(r.replicate, 0) + r.times
    tests = {r.replicate: r.series_id for r in rows if r.split == "test"}
    assert len(tests) == 20 and set(drawn.values()) == {11}
    assert all(tests[k] not in train[k] for k in tests)
    assert len({frozenset(v) for v in train.values()}) > 10


def test_balanced_hot_class(spark):
    df = spark.range(1000).select(F.col("id").alias("sample_id"), (F.col("id") < 30).cast("int").alias("y"))
    got = {r.y: r["count"] for r in splits.balanced(df, "y", 1).groupBy("y").count().collect()}
    assert got == {0: 30, 1: 30}


@pytest.mark.parametrize("block", [7, 1000])
def test_neighbours_match_brute_force(spark, block):
    rng = np.random.default_rng(4)
    x, y, fold = rng.normal(size=(60, 5)), rng.integers(0, 2, 60), np.arange(60) % 3
    rows = [(int(i), int(y[i]), int(fold[i]), [float(v) for v in x[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id LONG, y INT, fold INT, features ARRAY<DOUBLE>")
    got = {r.sample_id: r.prob for r in models.nearest_neighbours(df, 5, 3, block_rows=block).collect()}
    for i in range(60):
        others = np.where(fold != fold[i])[0]
        near = others[np.argsort(((x[others] - x[i]) ** 2).sum(1), kind="stable")[:5]]
        assert got[i] == pytest.approx(y[near].mean())


def test_classifier_separates_blobs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 2, i % 4 // 2, [float(v) for v in rng.normal(size=3) + 6 * (i % 2)]) for i in range(80)]
    df = spark.createDataFrame(rows, "sample_id LONG, y INT, fold INT, features ARRAY<DOUBLE>")
    for name in models.CLASSIFIERS:
        out = models.fit_predict(df, name, 2)
        assert out.filter("y = y_pred").count() >= 76
