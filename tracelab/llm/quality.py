"""Quality classifier with hierarchical empirical Bayes.

A linear model reads each text.  What it says is added up by host and by path; sparse paths shrink towards their host and sparse
hosts towards the corpus, as far as the spread between them warrants, and the path's posterior shifts the verdict on each text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.hashing import fraction
from tracelab.llm.common import identified, restored
from tracelab.session import materialise

FEATURES = 2**16
SAMPLE = 20_000  # labelled rows that the model is fitted on, on average; a bound whatever the corpus
SITE_WEIGHT = 0.5
EDGE = 1e-6


def features(text: Column) -> Column:
    """The distinct words in lower case, and marks for the text's shape: length, capitals, signs, digits, repetition."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    n = F.greatest(F.char_length(text), F.lit(1))
    share = lambda what, pattern: F.concat(F.lit(f"#{what}"), F.floor(F.lit(20) * F.regexp_count(text, F.lit(pattern)) / n).cast("string"))
    new = F.floor(F.lit(10) * F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)))
    shape = F.array(
        F.concat(F.lit("#length"), F.floor(F.log2(n)).cast("string")), share("capitals", r"\p{Lu}"), share("signs", r"[^\p{L}\p{N}\s.,]"),
        share("digits", "[0-9]"), F.concat(F.lit("#new"), new.cast("string")),
    )
    return F.concat(F.array_distinct(words), shape)


@dataclass
class TextModel:
    """A fitted model, or one chance for all texts where the labels do not tell two classes apart."""

    model: LogisticRegressionModel | None
    chance: float

    def score(self, docs: DataFrame) -> DataFrame:
        """Adds ``p_text``, the chance that a text is good, between ``EDGE`` and its complement."""
        if self.model is None:
            return docs.withColumn("p_text", F.lit(self.chance))
        vectors = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_words", outputCol="_vector").transform(docs.withColumn("_words", features(F.col("text"))))
        scored = self.model.transform(vectors)
        p = F.get(vector_to_array("_chance"), F.lit(1))
        return scored.withColumn("p_text", F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))).drop("_words", "_vector", "_raw", "_chance", "_verdict")


def fit(base: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> TextModel:
    """A model of good (quality 1, not toxic) against other texts, on about ``sample`` labelled rows drawn by a hash of their id."""
    known = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        ((F.min("quality") == 1) & (F.max("toxic") == 0)).cast("double").alias("good")
    )
    n, good = known.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0.0))).first()
    if n == 0 or good in (0, n):
        return TextModel(None, float((good + 1) / (n + 2)))
    drawn = known.where(fraction("quality", "doc_id") < min(1.0, sample / n)).select(F.col("doc_id").alias("id"), "good")
    rows = base.select("id", "text").join(F.broadcast(drawn), "id").select("good", features(F.col("text")).alias("_words"))
    rows = materialise(rows, "labelled-features")
    if rows.select("good").distinct().count() < 2:
        return TextModel(None, float((good + 1) / (n + 2)))
    vectors = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_words", outputCol="_vector").transform(rows)
    learner = LogisticRegression(
        featuresCol="_vector", labelCol="good", rawPredictionCol="_raw", probabilityCol="_chance", predictionCol="_verdict",
        regParam=1e-4, elasticNetParam=0.0, standardization=False, maxIter=40,
    )
    return TextModel(learner.fit(vectors), 0.5)


def _pull(total: Column, mean: Column, spread: Column, groups: Column) -> Column:
    """How many texts' worth of weight the level above has: few if groups differ by more than chance, many if not."""
    chance = mean * (1 - mean)
    excess = F.greatest(spread - chance * groups / total, chance * 1e-4)
    return F.greatest(F.lit(1.0), chance / excess - 1)


def posteriors(scored: DataFrame) -> DataFrame:
    """``(host, path, n_path, prior, p_host, p_path)`` from ``host``, ``path`` and ``p_text`` of all texts."""
    paths = materialise(scored.groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum("p_text").alias("s_path")), "path-sums")
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    whole = hosts.agg(
        F.struct(F.sum("n_host").alias("n"), (F.sum("s_host") / F.sum("n_host")).alias("prior"), F.count("*").alias("hosts")).alias("whole")
    )
    hosts = hosts.withColumn("whole", whole.scalar()).select("host", "n_host", "s_host", "whole.*")
    off = F.col("s_host") / F.col("n_host") - F.col("prior")
    spread = F.sum(F.col("n_host") * off * off) / F.sum("n_host")
    pull = hosts.agg(_pull(F.first("n"), F.first("prior"), spread, F.first("hosts")).alias("pull"))
    hosts = hosts.withColumn("pull", pull.scalar()).withColumn("p_host", (F.col("s_host") + F.col("pull") * F.col("prior")) / (F.col("n_host") + F.col("pull")))
    joined = paths.join(hosts.drop("hosts", "pull").withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).drop("of")
    off = F.col("s_path") / F.col("n_path") - F.col("s_host") / F.col("n_host")
    spread = F.sum(F.col("n_path") * off * off) / F.sum("n_path")
    pull = joined.agg(_pull(F.first("n"), F.first("prior"), spread, F.count("*")).alias("pull"))
    return joined.withColumn("pull", pull.scalar()).select(
        "host", "path", "n_path", "prior", "p_host",
        ((F.col("s_path") + F.col("pull") * F.col("p_host")) / (F.col("n_path") + F.col("pull"))).alias("p_path"),
    )


def judged(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None,
    *, sample: int = SAMPLE, site_weight: float = SITE_WEIGHT, least: float = 0.5,
) -> DataFrame:
    """``(id, fp, p_text, p_host, p_path, p_keep, keep)``: the verdict on every row.

    ``host`` and ``path`` are columns of ``docs`` (``source``, and ``lang`` within it, by default); null is a site of its own.  ``p_keep`` moves
    the text's log-odds by ``site_weight`` times those of its path against the corpus, and ``keep`` asks for ``least``.  A null text is empty
    and judged by its shape.  A repeated row gets its verdict again.  Without labels, or with labels of one class, every text has the labels'
    smoothed chance.  An empty table gives an empty result; extra columns are not carried.
    """
    base = identified(docs, id_col, text_col)
    model = fit(base, labels, sample)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    sited = identified(docs.withColumns({"_host": host.cast("string"), "_path": path.cast("string")}), id_col, text_col).select(
        "id", "fp", F.col("row._host").alias("host"), F.col("row._path").alias("path"), "text"
    )
    scored = materialise(model.score(sited).select("id", "fp", "host", "path", "p_text"), "text-scores")
    sites = materialise(posteriors(scored), "site-posteriors").withColumnsRenamed({"host": "s_host", "path": "s_path"})
    odds = lambda p: F.log(p / (1 - p))
    bound = lambda p: F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))
    both = scored.join(sites, F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")))
    shifted = odds(F.col("p_text")) + site_weight * (odds(bound(F.col("p_path"))) - odds(bound(F.col("prior"))))
    both = both.withColumn("p_keep", 1 / (1 + F.exp(-shifted)))
    return both.select("id", "fp", "p_text", "p_host", "p_path", "p_keep", (F.col("p_keep") >= least).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that the verdict keeps, with all their columns."""
    gone = materialise(judged(docs, labels, id_col, text_col, **how).where(~F.col("keep")).select("id", "fp").distinct(), "rejected")
    base = identified(docs, id_col, text_col)
    left = base.join(gone, base["id"].eqNullSafe(gone["id"]) & (base["fp"] == gone["fp"]), "left_anti")
    return restored(left, docs)
