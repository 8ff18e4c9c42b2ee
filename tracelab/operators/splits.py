"""Train/test assignments as rows: folds, leave-out, bootstrap, temporal and cross-farm splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.hashing import SPAN, draw, draw_bucket
from tracelab.functions.scan import ranked
from tracelab.operators.combinations import drawn_combinations
from tracelab.operators.labels import halves
from tracelab.session import materialise

BLOCK = 4096  # individuals of a block
PAIR_BLOCK = 32_768  # individuals of a block where pairs are made


def hash_rank(df: DataFrame, keys: Sequence[str], hashed: Column, tie: str, name: str = "rank") -> DataFrame:
    """Row number by draw within ``keys``; the draw's own slices are the buckets."""
    out = df.withColumns({"_h": hashed, "_all": F.lit(0)})
    return ranked(out, [*keys, "_all"], ["_h", tie], draw_bucket(F.col("_h")), name).drop("_h", "_all")


def kfold(
    df: DataFrame, folds: int, *, repeats: int = 1, seed: int = 0, key: str = "sample_id", stratify: str | None = None
) -> DataFrame:
    """``(repeat, key, fold)``: repeated, optionally stratified k folds of even size (M2)."""
    cols = [key] + ([stratify] if stratify else [])
    reps = df.select(*cols, F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    keys = ["repeat"] + ([stratify] if stratify else [])
    out = hash_rank(reps, keys, draw(seed, "repeat", key), key)
    return out.select("repeat", key, F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int").alias("fold"))


def individuals(samples: DataFrame, target: str = "target", key: str = "series_id") -> DataFrame:
    """Per individual: sample count and the smallest and largest class (two-class targets)."""
    return samples.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(target) == 1).alias("positives")
    )


def leave_one_out(samples: DataFrame, *, target: str = "target", key: str = "series_id") -> DataFrame:
    """Folds that test one individual; folds whose training set has one class are left out (M3)."""
    per = individuals(samples, target, key)
    total = per.groupBy().agg(F.struct(F.sum("n").alias("n"), F.sum("positives").alias("p")).alias("t")).scalar()
    out = per.withColumn("_t", total).withColumns(
        {"train_n": F.col("_t.n") - F.col("n"), "train_pos": F.col("_t.p") - F.col("positives")}
    )
    both = (F.col("train_pos") > 0) & (F.col("train_pos") < F.col("train_n"))
    return out.filter(both).drop("_t")


def _every_pair(one: DataFrame, rows: int, stratified: bool) -> DataFrame:
    """``(_id0, _kind0, _id1, _kind1, n, p)``: every two of the individuals, in order of id, a null id last; ``stratified`` takes one of each kind.

    Two individuals of different blocks meet once, whichever has the smaller id, and are put in order afterwards; so nearly every pair that is looked at is a result.
    """
    blocks = max(1, math.ceil(rows / PAIR_BLOCK), min(16, rows // 128))
    cells = blocks**2 if stratified else blocks * (blocks + 1) // 2
    tasks = max(1, min(cells, 16 * one.sparkSession.sparkContext.defaultParallelism))
    own = F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")
    side = lambda df, c: df.select(F.col("_id").alias(f"_id{c}"), F.col("n").alias(f"_n{c}"), F.col("p").alias(f"_p{c}"), F.col("_kind").alias(f"_kind{c}"), own.alias(f"_{c}"))
    if stratified:
        left = side(one.where("_kind = 0"), "a").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = side(one.where("_kind = 1"), "b").withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    else:
        left = side(one, "a").withColumn("_b", F.explode(F.sequence(F.col("_a"), F.lit(blocks - 1))))
        right = side(one, "b").withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_b"))))
    a, b = F.col("_ida"), F.col("_idb")
    rising = (a < b) | (a.isNotNull() & b.isNull())
    on = (F.col("l._a") == F.col("r._a")) & (F.col("l._b") == F.col("r._b"))
    if not stratified:
        on = on & ((F.col("l._a") != F.col("l._b")) | rising)
    # neither side's size after the explode is known to Spark beforehand, so it must not send one to all tasks
    met = left.repartition(tasks, "_a", "_b").alias("l").join(right.repartition(tasks, "_a", "_b").hint("merge").alias("r"), on)
    first, last = (lambda c: F.when(rising, F.col(f"{c}a")).otherwise(F.col(f"{c}b"))), (lambda c: F.when(rising, F.col(f"{c}b")).otherwise(F.col(f"{c}a")))
    return met.select(
        first("_id").alias("_id0"), last("_id").alias("_id1"), (F.col("_na") + F.col("_nb")).alias("n"), (F.col("_pa") + F.col("_pb")).alias("p"),
        first("_kind").alias("_kind0"), last("_kind").alias("_kind1"),
    )


def _every_combination(one: DataFrame, n: int, rows: int, stratified: bool) -> DataFrame:
    """``(_id0, …, n, p)``: every ``n`` of the individuals, in order of id, a null id last; ``stratified`` wants different kinds."""
    if n == 1:
        return one.withColumnsRenamed({"_id": "_id0", "_kind": "_kind0"})
    blocks = max(1, math.ceil(rows / BLOCK), min(8, rows // 128))
    tasks = max(1, min(blocks**2, 8 * one.sparkSession.sparkContext.defaultParallelism))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    own = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int")
    combos = _every_pair(one, rows, stratified)
    for i in range(2, n):
        ids, kinds = ([F.col(f"{c}{j}") for j in range(i)] for c in ("_id", "_kind"))
        left = combos.withColumn("_a", own(*ids)).withColumn("_b", every)
        right = one.select(F.col("_id").alias(f"_id{i}"), F.col("n").alias("_n"), F.col("p").alias("_p"), F.col("_kind").alias(f"_kind{i}"))
        right = right.withColumn("_b", own(f"_id{i}")).withColumn("_a", every)
        last, new = ids[-1], F.col(f"_id{i}")
        later = (last < new) | (last.isNotNull() & new.isNull())
        if stratified:
            for kind in kinds:
                later = later & (kind != F.col(f"_kind{i}"))
        # neither side's size after the explode is known to Spark beforehand, so it must not send one to all tasks
        met = left.repartition(tasks, "_a", "_b").alias("l").join(
            right.repartition(tasks, "_a", "_b").hint("merge").alias("r"),
            (F.col("l._a") == F.col("r._a")) & (F.col("l._b") == F.col("r._b")) & later,
        )
        combos = met.select(*ids, new, (F.col("n") + F.col("_n")).alias("n"), (F.col("p") + F.col("_p")).alias("p"), *kinds, F.col(f"_kind{i}"))
    return combos


def leave_n_out(
    samples: DataFrame,
    n: int,
    *,
    target: str = "target",
    key: str = "series_id",
    stratified: bool = False,
    only: DataFrame | None = None,
    drawn: int | None = None,
    cap: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Folds that test ``n`` individuals, every combination once (M3).

    The combinations themselves are the result.  They grow from the per-individual counts, never
    from samples, by one member at a time: combinations and individuals are cut into blocks, and blocks meet
    pairwise, so that a row is shuffled once per block of the other side and never once per combination.
    Folds whose training set has one class are left out.  ``stratified`` wants single-class individuals, all of different class;
    ``only`` keeps folds whose smallest id is listed.  ``drawn`` builds only that many combinations, drawn
    by number, before any is left out; ``cap`` draws until that many folds are left, and keeps those drawn first.
    """
    if cap is not None:
        most = math.comb(samples.select(key).distinct().count(), n)
        count = min(most, 2 * cap)
        while True:
            folds = leave_n_out(samples, n, target=target, key=key, stratified=stratified, only=only, drawn=count, seed=seed).withColumn("_all", F.lit(0))
            kept = ranked(folds, ["_all"], ["rank"], F.floor(F.col("rank") / 4096), "_no").filter(F.col("_no") <= cap).drop("_no", "_all", "rank")
            if count >= most or kept.count() >= cap:
                return kept
            count = min(most, 4 * count)
    per = materialise(individuals(samples, target, key), "individuals")
    total = per.groupBy().agg(
        F.struct(F.sum("n").alias("n"), F.sum("positives").alias("p")).alias("t")
    ).scalar()
    # single-class individuals: 0 or 1, mixed ones: null
    kind = F.when(F.col("positives") == 0, 0).when(F.col("positives") == F.col("n"), 1)
    one = per.select(F.col(key).alias("_id"), "n", F.col("positives").alias("p"), kind.alias("_kind"))
    if drawn is not None:
        numbered = hash_rank(one, [], draw("combination", "_id"), "_id", "no")
        picked = drawn_combinations(samples.sparkSession, per.count(), n, drawn, seed)
        combos = picked.join(numbered, "no").groupBy("number", "rank").agg(
            F.array_sort(F.collect_list(F.struct(F.col("_id").isNull().alias("o"), F.col("_id").alias("id")))).alias("_ids"),
            F.sum("n").alias("n"), F.sum("p").alias("p"),
            F.collect_list(F.coalesce("_kind", F.lit(-1))).alias("_kinds"),
        )
        members, kinds = F.transform("_ids", lambda x: x["id"]), F.col("_kinds")
        parted = ~F.array_contains(kinds, -1) & (F.size(F.array_distinct(kinds)) == n)
        combos = combos.filter(parted) if stratified else combos
    else:
        if stratified:
            one = one.filter(F.col("_kind").isNotNull())
        combos = _every_combination(one, n, per.count(), stratified)
        members = F.array(*[F.col(f"_id{i}") for i in range(n)])
    out = combos.withColumn("_t", total).withColumns(
        {"train_n": F.col("_t.n") - F.col("n"), "train_pos": F.col("_t.p") - F.col("p"), "members": members}
    )
    out = out.filter((F.col("train_pos") > 0) & (F.col("train_pos") < F.col("train_n")))
    if only is not None:
        wanted = only.select(F.col(key).alias("_id"))
        out = out.join(wanted, F.get("members", F.lit(0)) == F.col("_id"), "left_semi")
    order = ["rank"] if drawn is not None else []
    return out.select("members", F.col("n").alias("test_n"), F.col("p").alias("test_pos"), "train_n", "train_pos", *order)


def leave_two_out(samples: DataFrame, *, key: str = "series_id", **options) -> DataFrame:
    """Pairs of left-out individuals as columns ``a`` and ``b`` (M3)."""
    out = leave_n_out(samples, 2, key=key, **options)
    first, second = F.get("members", F.lit(0)).alias("a"), F.get("members", F.lit(1)).alias("b")
    return out.select(first, second, "test_n", "test_pos", "train_n", "train_pos")


def resample_weights(ids: DataFrame, key: str, replicates: int, seed: int, *, draws_less: int = 0) -> DataFrame:
    """``(replicate, key, times)``: how often each id is drawn when as many as there are (less
    ``draws_less``) are drawn with replacement.

    The numbered ids are few next to the draws, so they are dealt out to all tasks before each draws for its own.
    """
    tasks = ids.sparkSession.sparkContext.defaultParallelism
    numbered = hash_rank(ids.select(key).distinct(), [], draw(seed, key), key, "no").repartition(tasks, "no")
    size = ids.groupBy().agg(F.count_distinct(key).alias("c")).scalar()
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    slots = numbered.withColumn("_c", size).filter(F.col("no") <= F.col("_c") - draws_less).select("no", "_c", reps)
    picks = slots.select("replicate", (F.pmod(draw(seed, "replicate", "no"), F.col("_c")) + 1).alias("no"))
    times = picks.groupBy("replicate", "no").agg(F.count(F.lit(1)).alias("times"))
    return times.join(numbered.select("no", key), "no").select("replicate", key, "times")


def individual_bootstrap(ids: DataFrame, replicates: int, seed: int, key: str = "series_id") -> DataFrame:
    """Per replicate: ``n - 1`` individuals drawn with replacement train, one unseen one tests (M4).

    Rows are ``(replicate, id, times, split)``; of the unseen individuals the one with the
    smallest draw tests.
    """
    drawn = resample_weights(ids, key, replicates, seed, draws_less=1)
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    every = ids.select(key).distinct().select(key, reps)
    unseen = every.join(drawn, ["replicate", key], "left_anti").groupBy("replicate").agg(
        F.min_by(key, F.struct(draw("test", "replicate", key), key)).alias(key)
    )
    train = drawn.withColumn("split", F.lit("train"))
    test = unseen.select("replicate", key, F.lit(1).cast("long").alias("times"), F.lit("test").alias("split"))
    return train.unionByName(test)


def drop_synthetic_test(folds: DataFrame, k: int) -> DataFrame:
    """Leave out test samples with ``k`` or more fully synthetic days (M5)."""
    return folds.filter(~((F.col("split") == "test") & (F.col("imputed_days") >= k)))


def temporal_split(visits: DataFrame) -> DataFrame:
    """Train on one half of each series' dates and test on the other, both ways (M6)."""
    directed = halves(visits).withColumn("direction", F.explode(F.array(F.lit(1), F.lit(2))))
    split = F.when(F.col("half") == F.col("direction"), "train").otherwise("test")
    return directed.withColumn("split", split)


def cross_source_split(df: DataFrame, sources: Sequence[str] | None = None, source: str = "source") -> DataFrame:
    """Train on one source and test on the other, both ways (M7).

    Without ``sources`` each source of the data trains once, and rows whose source is null are only tested.
    """
    if sources is not None:
        df = df.filter(F.col(source).isin(*sources))
    # the sources are read as a subquery of the same plan; a row is copied once per source, which is what the split is
    each = df.groupBy().agg(F.sort_array(F.collect_set(source)).alias("s")).scalar()
    directed = df.withColumn("_sources", each).withColumn("direction", F.explode("_sources")).drop("_sources")
    return directed.withColumn("split", F.when(F.col(source) == F.col("direction"), "train").otherwise("test"))


def training_subsets(
    df: DataFrame, subsets: int, fraction: float, seed: int, *, key: str = "sample_id", target: str = "y"
) -> DataFrame:
    """``subsets`` draws of a share of the samples; draws of a single class are rejected (M8)."""
    reps = df.select(key, target, F.explode(F.sequence(F.lit(1), F.lit(subsets))).alias("subset"))
    drawn = reps.filter(draw(seed, "subset", key) < F.lit(int(fraction * SPAN)))
    usable = drawn.groupBy("subset").agg(F.min(target).alias("_lo"), F.max(target).alias("_hi"))
    return drawn.join(usable.filter(F.col("_lo") < F.col("_hi")).select("subset"), "subset", "left_semi")


def balanced(df: DataFrame, target: str, seed: int, key: str = "sample_id") -> DataFrame:
    """Down-sample every class to the size of the smallest by draw."""
    smallest = df.groupBy(target).agg(F.count(F.lit(1)).alias("c")).groupBy().agg(F.min("c").alias("m")).scalar()
    return hash_rank(df, [target], draw(seed, key), key).filter(F.col("rank") <= smallest).drop("rank")


def balanced_first(df: DataFrame, target: str, key: str, bucket: Column) -> DataFrame:
    """The first rows of every class by ``key``, as many as the smallest class has."""
    smallest = df.groupBy(target).agg(F.count(F.lit(1)).alias("c")).groupBy().agg(F.min("c").alias("m")).scalar()
    return ranked(df, [target], [key], bucket, "rank").filter(F.col("rank") <= smallest).drop("rank")


def fold_table(folds: DataFrame, n: int, key: str = "sample_id") -> DataFrame:
    """``(fold, key, split)`` rows, every sample once per fold (K3)."""
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k")
    out = folds.select("repeat", key, F.col("fold").alias("_own"), every)
    split = F.when(F.col("_own") == F.col("_k"), "test").otherwise("train")
    return out.select("repeat", F.col("_k").alias("fold"), key, split.alias("split"))
