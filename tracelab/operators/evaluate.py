"""Exact classification metrics from predictions, tie-aware and without sorting a fold in one task.

Predictions are first counted per ``(keys, score)``; the cumulative counts over descending score
run through value buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.quantile import quantiles, value_bucket
from tracelab.functions.scan import neighbours, scan
from tracelab.operators.splits import resample_weights
from tracelab.session import materialise

ROWS = 4096  # scores whose counts are weighted at a time


def confusion(df: DataFrame, keys: Sequence[str], *, y: str = "y", pred: str = "y_pred") -> DataFrame:
    """Confusion counts and precision, recall, F1, support per class, balanced accuracy."""
    a, p = F.col(y), F.col(pred)
    base = df.groupBy(*keys).agg(
        F.count_if((a == 1) & (p == 1)).alias("tp"),
        F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 0) & (p == 0)).alias("tn"),
        F.count_if((a == 1) & (p == 0)).alias("fn"),
    )

    def share(top: str, *parts: str) -> Column:
        total = F.col(parts[0])
        for q in parts[1:]:
            total = total + F.col(q)
        return F.when(total > 0, F.col(top) / total).otherwise(F.lit(0.0))

    out = base.withColumns(
        {
            "precision_1": share("tp", "tp", "fp"),
            "recall_1": share("tp", "tp", "fn"),
            "precision_0": share("tn", "tn", "fn"),
            "recall_0": share("tn", "tn", "fp"),
            "support_1": F.col("tp") + F.col("fn"),
            "support_0": F.col("tn") + F.col("fp"),
        }
    )
    for c in ("0", "1"):
        pr, rc = F.col(f"precision_{c}"), F.col(f"recall_{c}")
        out = out.withColumn(f"f1_{c}", F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(F.lit(0.0)))
    return out.withColumn("balanced_accuracy", (F.col("recall_0") + F.col("recall_1")) / 2)


def score_counts(df: DataFrame, keys: Sequence[str], *, y: str, score: str, times: Column | None = None) -> DataFrame:
    """Positives and negatives per distinct score."""
    w = times if times is not None else F.lit(1).cast("long")
    return df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(F.lit(0).cast("long"))).alias("pos"),
        F.sum(F.when(F.col(y) == 1, F.lit(0).cast("long")).otherwise(w)).alias("neg"),
    )


def cumulative(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """True and false positives at each threshold ``score``, and the totals of the key."""
    keys = list(keys)
    down = -F.col("score")
    placed = counts.withColumns({"_one": F.lit(0), "_down": down, "_at": value_bucket(down)})
    run = scan(
        placed,
        [*keys, "_one"],
        ["_down"],
        F.col("_at"),
        cumsum={"tp": F.col("pos"), "fp": F.col("neg")},
        whole={"p_total": ("sum", F.col("pos")), "n_total": ("sum", F.col("neg"))},
    )
    return run.drop("_down", "_at", "_one")


def roc_curve(df: DataFrame, keys: Sequence[str], *, y: str = "y", score: str = "score") -> DataFrame:
    """``(threshold, fpr, tpr)`` for every distinct score."""
    run = cumulative(score_counts(df, keys, y=y, score=score), keys)
    return run.select(
        *keys,
        F.col("score").alias("threshold"),
        F.try_divide("fp", "n_total").alias("fpr"),
        F.try_divide("tp", "p_total").alias("tpr"),
    )


def rank_auc(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the ROC curve from score counts: the share of ordered pairs, ties half."""
    run = cumulative(counts, keys)
    above = F.col("tp") - F.col("pos")
    won = F.sum(F.col("neg") * (above + F.col("pos") / 2.0))
    pairs = F.max("p_total").cast("double") * F.max("n_total")
    return run.groupBy(*keys).agg(F.when(pairs > 0, won / pairs).alias("auc"), F.max("p_total").alias("positives"), F.max("n_total").alias("negatives"))


def auc(df: DataFrame, keys: Sequence[str], *, y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties handled."""
    return rank_auc(score_counts(df, keys, y=y, score=score), keys)


def interpolated_roc(df: DataFrame, key: str, *, points: int = 100, y: str = "y", score: str = "score") -> DataFrame:
    """Each fold's true-positive rate on an even grid of false-positive rates."""
    run = cumulative(score_counts(df, [key], y=y, score=score), [key])
    run = run.filter((F.col("p_total") > 0) & (F.col("n_total") > 0))
    cols = [key, "fp", "tp", "p_total", "n_total"]
    origin = run.groupBy(key).agg(F.max("p_total").alias("p_total"), F.max("n_total").alias("n_total"))
    zero = F.lit(0).cast("long")
    curve = run.select(*cols).unionByName(origin.select(key, zero.alias("fp"), zero.alias("tp"), "p_total", "n_total"))
    steps = curve.groupBy(key, "fp", "p_total", "n_total").agg(F.max("tp").alias("top"), F.min("tp").alias("low"))
    paired = neighbours(
        steps, [key], ["fp"], F.floor(F.col("fp") / 65536), {"_fp": (F.col("fp"), -1), "_low": (F.col("low"), -1)}
    )
    last = points - 1
    start = F.ceil(F.col("fp") * last / F.col("n_total"))
    stop = F.when(F.col("_fp").isNull(), F.lit(last).cast("long")).otherwise(F.ceil(F.col("_fp") * last / F.col("n_total")) - 1)
    at = paired.withColumns({"_a": start, "_b": stop}).filter(F.col("_a") <= F.col("_b"))
    at = at.withColumn("i", F.explode(F.sequence("_a", "_b")))
    x = F.col("i") / F.lit(float(last)) * F.col("n_total")
    rise = F.coalesce((F.col("_low") - F.col("top")) / (F.col("_fp") - F.col("fp")) * (x - F.col("fp")), F.lit(0.0))
    tpr = (F.col("top") + rise) / F.col("p_total")
    return at.select(key, F.col("i").cast("int").alias("i"), F.when(F.col("i") == 0, F.lit(0.0)).otherwise(tpr).alias("tpr"))


def mean_roc(df: DataFrame, key: str, **kw) -> DataFrame:
    """Mean interpolated curve over folds, ending at 1."""
    points = kw.get("points", 100)
    out = interpolated_roc(df, key, **kw).groupBy("i").agg(F.avg("tpr").alias("tpr"), F.count(F.lit(1)).alias("folds"))
    return out.withColumn("tpr", F.when(F.col("i") == points - 1, F.lit(1.0)).otherwise(F.col("tpr")))


def precision_recall(df: DataFrame, keys: Sequence[str], *, y: str = "y", score: str = "score") -> DataFrame:
    """Precision and recall at every distinct score."""
    run = cumulative(score_counts(df, keys, y=y, score=score), keys)
    return run.select(
        *keys,
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("p_total") > 0, F.col("tp") / F.col("p_total")).alias("recall"),
    )


def average_precision(df: DataFrame, keys: Sequence[str], *, y: str = "y", score: str = "score") -> DataFrame:
    """Precision weighted by the rise in recall."""
    run = cumulative(score_counts(df, keys, y=y, score=score), keys)
    gain = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return run.groupBy(*keys).agg(F.when(F.max("p_total") > 0, gain / F.max("p_total")).alias("average_precision"))


def weight_arrays(draws: DataFrame, key: str, replicates: int) -> DataFrame:
    """``(key, weights)``: how often each key is drawn in replicates 1 to ``replicates``, as one array."""


    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column(1)
            weights = np.zeros((len(told), replicates), np.int64)
            row = np.repeat(np.arange(len(told)), pc.list_value_length(told).to_numpy(zero_copy_only=False))
            replicate, times = told.flatten().flatten()
            weights[row, replicate.to_numpy() - 1] = times.to_numpy()
            sizes = np.arange(len(told) + 1, dtype=np.int32) * replicates
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(sizes, weights.ravel())], [key, "weights"])

    kind = draws.schema[key].dataType.simpleString()
    each = draws.groupBy(key).agg(F.collect_list(F.struct("replicate", "times")).alias("_t"))
    return each.mapInArrow(spread, f"`{key}` {kind}, weights array<long>")


def weighted_totals(df: DataFrame, columns: Sequence[str], replicates: int) -> DataFrame:
    """``(replicate, columns)``: sums of the columns weighted by the array ``weights``, added up in the tasks first: one set of arrays each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(columns), replicates))
        for batch in batches:
            weights = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, replicates)
            for i in range(len(columns)):
                totals[i] += batch.column(i + 1).to_numpy(zero_copy_only=False).astype(np.float64) @ weights
        yield pa.RecordBatch.from_arrays([pa.array([t.tolist()]) for t in totals], list(columns))

    parts = df.select("weights", *columns).mapInArrow(run, ", ".join(f"{c} array<double>" for c in columns))
    each = parts.select(F.posexplode(F.arrays_zip(*columns)).alias("_at", "a"))
    return each.groupBy((F.col("_at") + 1).alias("replicate")).agg(*[F.sum(f"a.{c}").alias(c) for c in columns])


def replicate_auc(counts: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    """``(keys, replicate, auc)`` from ``(keys, score, pos, neg, weights)``: the pooled counts of every replicate at once.

    Scores are cut into buckets.  A bucket adds up arrays over the replicates: its positives, negatives and the pairs won inside it, in one pass
    down the scores whose state is an array.  Only these arrays, one set per bucket, are written out by replicate.
    """
    keys = list(keys)
    size = replicates

    def inside(table: pa.Table) -> pa.Table:
        order = np.argsort(-table.column("score").to_numpy(), kind="stable")
        score = table.column("score").to_numpy()[order]
        pos, neg = (table.column(c).to_numpy()[order] for c in ("pos", "neg"))
        weights = table.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)[order]
        first = np.nonzero(np.diff(score, prepend=np.nan) != 0)[0]
        above, below, won = (np.zeros(size, np.int64) for _ in range(3))
        for at in range(0, len(first), ROWS):
            cut = slice(first[at], first[at + ROWS] if at + ROWS < len(first) else len(score))
            edges = first[at : at + ROWS] - first[at]
            p = np.add.reduceat(pos[cut, None] * weights[cut], edges, axis=0)
            n = np.add.reduceat(neg[cut, None] * weights[cut], edges, axis=0)
            higher = above + np.cumsum(p, axis=0) - p
            won += (n * (2 * higher + p)).sum(axis=0)  # twice the pairs, so that ties stay whole
            above, below = above + p.sum(axis=0), below + n.sum(axis=0)
        out = {k: table.column(k).slice(0, 1) for k in [*keys, "bucket"]}
        return pa.table({**out, "p": [above], "n": [below], "won": [won]})

    placed = counts.withColumn("bucket", value_bucket(-F.col("score")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*keys).schema.fields)
    shape = f"{kinds + ', ' if kinds else ''}bucket long, p array<long>, n array<long>, won array<long>"
    parts = placed.select(*keys, "bucket", "score", "pos", "neg", "weights").groupBy(*keys, "bucket").applyInArrow(inside, shape)
    each = parts.select(*keys, "bucket", F.posexplode(F.arrays_zip("p", "n", "won")).alias("_at", "a"))
    each = each.select(*keys, (F.col("_at") + 1).alias("replicate"), "bucket", "a.*")
    higher = Window.partitionBy(*keys, "replicate").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    run = each.withColumn("_above", F.coalesce(F.sum("p").over(higher), F.lit(0)))
    pairs = F.sum("p").cast("double") * F.sum("n")
    won = F.sum(F.col("won").cast("double") + 2.0 * F.col("n") * F.col("_above")) / 2
    return run.groupBy(*keys, "replicate").agg(F.when(pairs > 0, won / pairs).alias("auc"))


def bootstrap_metrics(
    df: DataFrame, fold: str, replicates: int, seed: int, *, y: str = "y", score: str = "score", pred: str = "y_pred", split: str | None = None
) -> DataFrame:
    """Per replicate: whole folds drawn with replacement, pooled AUC and precision.

    Only counts per (fold, score) are weighted, by one array per fold.  With ``split``, a column that says ``train`` or ``test``, AUC and precision are those
    of the test rows, and ``train_auc`` is that of the training rows under the same draws.
    """
    weights = materialise(weight_arrays(resample_weights(df, fold, replicates, seed), fold, replicates), "fold-weights")
    side = F.lit("test") if split is None else F.col(split)
    told = df.withColumn("_side", side)
    counts = score_counts(told, ["_side", fold], y=y, score=score).join(weights, fold)
    auc = replicate_auc(counts.select("_side", "score", "pos", "neg", "weights"), ["_side"], replicates)
    sides = {"auc": "test"} if split is None else {"auc": "test", "train_auc": "train"}
    wide = auc.groupBy("replicate").agg(*[F.max(F.when(F.col("_side") == s, F.col("auc"))).alias(name) for name, s in sides.items()])
    flagged = told.filter((F.col(pred) == 1) & (F.col("_side") == "test")).groupBy(fold).agg(F.sum(y).alias("_tp"), F.count(F.lit(1)).alias("_n"))
    hits = weighted_totals(flagged.join(weights, fold), ["_tp", "_n"], replicates)
    precision = hits.select("replicate", F.try_divide("_tp", "_n").alias("precision"))
    return wide.join(precision, "replicate", "left")


def bootstrap_interval(metrics: DataFrame, metric: str) -> DataFrame:
    """Median and 95 % interval of a bootstrapped metric."""
    return quantiles(metrics, [], metric, {"low": 0.025, "median": 0.5, "high": 0.975})


def normal_tail(z: Column, terms: int = 60) -> Column:
    """Upper tail of the standard normal for ``z >= 0``, exact to about ten digits of its own size.

    Near the middle by the series of odd powers, beyond three by the continued fraction.
    """
    density = F.exp(-z * z / 2) * F.lit((2 * math.pi) ** -0.5)
    odd = F.array(*[F.lit(float(2 * n + 1)) for n in range(terms, 0, -1)])
    series = F.aggregate(odd, F.lit(1.0), lambda s, k: F.lit(1.0) + s * z * z / k)
    steps = F.array(*[F.lit(float(k)) for k in range(terms, 0, -1)])
    fraction = F.aggregate(steps, z, lambda f, k: z + k / f)
    return F.when(z < 3, F.lit(0.5) - density * z * series).otherwise(density / fraction)


def mann_whitney(df: DataFrame, keys: Sequence[str], *, group: str = "y", value: str = "score") -> DataFrame:
    """U of the group-1 values, tie-corrected z with continuity correction, two-sided p."""
    counts = score_counts(df, keys, y=group, score=value)
    run = cumulative(counts, keys)
    below = F.col("n_total") - F.col("fp")
    u = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    t = (F.col("pos") + F.col("neg")).cast("double")
    out = run.groupBy(*keys).agg(
        u.alias("u"),
        F.max("p_total").cast("double").alias("n1"),
        F.max("n_total").cast("double").alias("n2"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    far = F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - F.lit(0.5)
    z = F.try_divide(F.greatest(far, F.lit(0.0)), sd)
    return out.withColumn("z", z).withColumn("p", 2 * normal_tail(F.col("z"))).drop("_ties")


def mann_whitney_exact(df: DataFrame, keys: Sequence[str], *, group: str = "y", value: str = "score", most: int = 20) -> DataFrame:
    """``(keys, u, n1, n2, p)`` with the exact two-sided p of small groups, ties included.

    The chance is over all ways to pick which values are of group 1; they are counted by how many were picked and the sum of their doubled middle
    ranks, one distinct value after the other.  Keys in which either group is empty or has more than ``most`` values are left out:
    ``mann_whitney`` is for these.
    """
    if most > 30:
        raise ValueError("ways to pick from more values may not fit into 64 bits")
    keys = list(keys)
    counts = score_counts(df.where(F.col(value).isNotNull() & F.col(group).isin(0, 1)), keys, y=group, score=value)
    sizes = counts.groupBy(*keys).agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n2"))
    small = counts.join(sizes.where(F.col("n1").between(1, most) & F.col("n2").between(1, most)), keys)

    def exact(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("score")
        pos, both = rows["pos"].to_numpy(), (rows["pos"] + rows["neg"]).to_numpy()
        n1, n = int(pos.sum()), int(both.sum())
        rank = 2 * np.cumsum(both) - both + 1  # twice the middle rank of equal values
        ways = np.zeros((n1 + 1, 2 * n * n1 + 1), np.int64)  # by number picked and sum
        ways[0, 0] = 1
        for r in np.repeat(rank, both).tolist():
            for k in range(n1, 0, -1):
                ways[k, r:] += ways[k - 1, : ways.shape[1] - r]
        seen = int((pos * rank).sum())
        every, low, high = math.comb(n, n1), int(ways[n1, : seen + 1].sum()), int(ways[n1, seen:].sum())
        out = rows.iloc[:1][keys].copy()
        return out.assign(u=seen / 2 - n1 * (n1 + 1) / 2, n1=n1, n2=n - n1, p=min(1.0, 2 * min(low, high) / every))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*keys).schema.fields)
    return small.select(*keys, "score", "pos", "neg").groupBy(*keys).applyInPandas(exact, f"{kinds}, u double, n1 long, n2 long, p double")


def accuracy_per_fold(df: DataFrame, fold: str, key: str, *, y: str = "y", pred: str = "y_pred") -> DataFrame:
    """Every fold's accuracy beside each individual it tests, best fold first."""
    hit = (F.col(y) == F.col(pred)).cast("int")
    acc = df.groupBy(fold).agg(F.avg(hit).alias("accuracy"))
    return df.select(fold, key).distinct().join(acc, fold).orderBy(F.col("accuracy").desc(), fold, key)


def individual_hits(df: DataFrame, keys: Sequence[str], *, y: str = "y", pred: str = "y_pred") -> DataFrame:
    """Correct and incorrect predictions and their ratio in percent."""
    ok = F.col(y) == F.col(pred)
    out = df.groupBy(*keys).agg(F.count_if(ok).alias("correct"), F.count_if(~ok).alias("incorrect"))
    return out.withColumn("ratio", F.col("correct") * 100.0 / (F.col("correct") + F.col("incorrect")))


def ensemble_vote(df: DataFrame, keys: Sequence[str], *, pred: str, prob: str) -> DataFrame:
    """Mean prediction over models against 0.5, and mean probability."""
    return df.groupBy(*keys).agg((F.avg(pred) > 0.5).cast("int").alias("vote"), F.avg(prob).alias("prob"))
