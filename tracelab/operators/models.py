"""Classifiers, clusters and reductions from MLlib, fold by fold."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.operators import neighbours
from tracelab.operators.normalise import centre_positions

CLASSIFIERS = {
    "linear": lambda **kw: LinearSVC(featuresCol="vector", labelCol="y", **kw),
    "logistic": lambda **kw: LogisticRegression(featuresCol="vector", labelCol="y", **kw),
    "tree": lambda **kw: DecisionTreeClassifier(featuresCol="vector", labelCol="y", **kw),
}


def with_vector(df: DataFrame) -> DataFrame:
    return df.withColumn("vector", array_to_vector("features"))


def fit_predict(df: DataFrame, classifier: str, folds: int, **params) -> DataFrame:
    """Train on the other folds and predict each fold.

    ``df``: ``(sample_id, y, fold, features)``.  The loop runs over the few folds; each fit is a
    distributed job over all of its training rows.
    """
    if classifier not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {classifier}; known are {sorted(CLASSIFIERS)}")
    ready = with_vector(df)
    out = None
    for fold in range(folds):
        model = CLASSIFIERS[classifier](**params).fit(ready.filter(F.col("fold") != fold))
        pred = model.transform(ready.filter(F.col("fold") == fold))
        margin = F.get(vector_to_array("rawPrediction"), F.lit(1))
        prob = F.get(vector_to_array("probability"), F.lit(1)) if "probability" in pred.columns else margin
        part = pred.select(
            "sample_id", "fold", "y", F.col("prediction").cast("int").alias("y_pred"), prob.alias("prob")
        )
        out = part if out is None else out.unionByName(part)
    return out


def principal_components(df: DataFrame, k: int) -> DataFrame:
    """Samples reduced to ``k`` components of the centred features."""
    ready = with_vector(centre_positions(df))
    model = PCA(k=k, inputCol="vector", outputCol="reduced").fit(ready)
    return model.transform(ready).withColumn("features", vector_to_array("reduced")).drop("vector", "reduced")


def clusters(df: DataFrame, k: int, seed: int = 0, **params) -> DataFrame:
    """k-means cluster of each sample."""
    ready = with_vector(df)
    model = KMeans(k=k, seed=seed, featuresCol="vector", predictionCol="cluster", **params).fit(ready)
    return model.transform(ready).drop("vector")


def nearest_neighbours(df: DataFrame, k: int | None, folds: int, *, block_rows: int = 4096, seed: int = 0, pivots: int = neighbours.PIVOTS) -> DataFrame:
    """Exact k-nearest-neighbour vote for every sample of every fold.

    ``df``: ``(sample_id, y, fold, features)``; without ``k`` it is the floored root of the number of training rows.  Ties go to the smaller
    training id.  ``neighbours.nearest`` finds the rows over pivot cells.
    """
    listed = df.filter(F.col("fold").between(0, folds - 1))
    return neighbours.vote(neighbours.nearest(listed, k, pivots=pivots, block_rows=block_rows, seed=seed))
