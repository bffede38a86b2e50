"""Training and scoring with Spark ML on ``(id, label, features)`` rows, features a complete array."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.split import split_exact, split_ordered, stratified_folds
from ..session import materialize_measured

MAX_TREE_DEPTH = 30  # what Spark ML trees allow
PARTITION_VALUES = 8_000_000  # of the training vectors, 64 MB


def with_vectors(m: DataFrame, features: str = "features") -> DataFrame:
    """Adds the ML vector column ``input`` and a numeric ``label``."""
    out = m.withColumn("input", array_to_vector(F.col(features)))
    return out.withColumn("label", F.col("label").cast("double")) if "label" in m.columns else out


def boosted_trees(n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 10, subsample: float = 0.8,
                  colsample: float = 0.8, gamma: float = 0.1, min_child_weight: float = 1, seed: int = 123,
                  max_memory_mb: int = 1024, checkpoint_interval: int = 10) -> GBTClassifier:
    """Gradient-boosted trees by the usual boosting parameter names.

    ``colsample`` applies per node and ``min_child_weight`` counts rows; there is no L1 penalty on leaves. Large
    feature counts need ``max_memory_mb`` so that a level of the tree is grown in few passes. A fraction of
    ``min_child_weight`` counts as the next whole row; deeper trees than ``MAX_TREE_DEPTH`` are an error.
    """
    if int(max_depth) > MAX_TREE_DEPTH:
        raise ValueError(f"trees have at most {MAX_TREE_DEPTH} levels, not {max_depth}")
    return GBTClassifier(
        featuresCol="input", labelCol="label", maxIter=int(n_estimators), stepSize=learning_rate,
        maxDepth=int(max_depth), subsamplingRate=subsample,
        featureSubsetStrategy=str(colsample) if colsample < 1 else "all", minInfoGain=gamma,
        minInstancesPerNode=max(1, math.ceil(min_child_weight)), seed=seed, maxMemoryInMB=max_memory_mb,
        checkpointInterval=checkpoint_interval)


def neural_net(n_features: int, n_classes: int = 2, hidden: tuple[int, ...] = (16, 8), steps: int = 1000,
               batch: int = 40, seed: int = 123) -> MultilayerPerceptronClassifier:
    """A feed-forward classifier with the given hidden layers.

    ``batch`` is the number of rows stacked per gradient computation; every step passes over all rows. A fit whose loss
    no longer falls by a millionth is done before its last step.
    """
    return MultilayerPerceptronClassifier(
        featuresCol="input", labelCol="label", layers=[n_features, *hidden, n_classes], maxIter=steps,
        blockSize=batch, seed=seed)


def kept(rows: DataFrame) -> DataFrame:
    """Training vectors, stored and cached in as many partitions as there are cores, more only for more values.

    Spark ML runs a job over all partitions for every step of a fit; as many as a shuffle happens to have would cost a
    task each, each time.
    """
    stored, seen = materialize_measured(rows, values=F.sum(F.size(vector_to_array("input"))))
    return stored.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-(seen["values"] or 0) // PARTITION_VALUES))).persist()


def fit(estimator: Estimator, train: DataFrame) -> PipelineModel:
    """Fit on cached training vectors."""
    rows = kept(with_vectors(train).select("label", "input"))
    try:
        return Pipeline(stages=[estimator]).fit(rows)
    finally:
        rows.unpersist()


def score(model: Transformer, m: DataFrame) -> DataFrame:
    """``(id, label if known, prediction, probability)``, the probability one number per class."""
    out = model.transform(with_vectors(m))
    keep = [c for c in m.columns if c != "features"]
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability").alias("probability"))


# The search grid; the L1 penalty has no counterpart here.
GRID = {"max_depth": [3, 10], "min_child_weight": [1, 6], "gamma": [0.0, 0.2, 0.4], "n_estimators": [100, 1000]}
_GRID_PARAMS = {"max_depth": "maxDepth", "min_child_weight": "minInstancesPerNode", "gamma": "minInfoGain",
                "n_estimators": "maxIter"}


def _weighted_f1() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="f1")


def grid_search(train: DataFrame, grid: dict[str, list] | None = None, folds: int = 5,
                estimator: GBTClassifier | None = None, parallelism: int = 4) -> CrossValidatorModel:
    """Stratified cross-validation over a parameter grid by weighted F1; the model is refitted with the best map."""
    estimator = estimator or boosted_trees()
    builder = ParamGridBuilder()
    for name, values in (grid or GRID).items():
        builder = builder.addGrid(estimator.getParam(_GRID_PARAMS[name]), values)
    rows = kept(stratified_folds(with_vectors(train), folds).select("label", "input", "fold"))
    try:
        search = CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=_weighted_f1(),
                                numFolds=folds, foldCol="fold", parallelism=parallelism)
        return search.fit(rows)
    finally:
        rows.unpersist()


# The ranges of the random search as (low, high, kind); depths end where trees do.
SPACE = {
    "n_estimators": (10, 1000, "integer"),
    "gamma": (0.001, 10.0, "log"),
    "min_child_weight": (0.001, 100.0, "log"),
    "max_depth": (2, MAX_TREE_DEPTH, "integer"),
    "colsample": (0.2, 1.0, "linear"),
    "subsample": (0.2, 1.0, "linear"),
}


def draw_params(trials: int, seed: int = 123, space: dict[str, tuple] | None = None) -> list[dict[str, float]]:
    """Random points of a search space; ``log`` draws evenly in magnitude."""
    rng = random.Random(seed)

    def draw(low, high, kind):
        if kind == "integer":
            return rng.randint(low, high)
        if kind == "log":
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        return rng.uniform(low, high)

    return [{n: draw(*bounds) for n, bounds in (space or SPACE).items()} for _ in range(trials)]


@dataclass
class Searched:
    """What a random search found."""

    bestModel: PipelineModel
    bestParams: dict[str, float]
    metrics: list[float]


def random_search(train: DataFrame, trials: int = 2, parallelism: int = 2, seed: int = 123,
                  space: dict[str, tuple] | None = None, hold_out: str = "ordered") -> Searched:
    """Try random parameters on one hold-out of 30 % by F1 and refit with the best, the first of equals.

    ``hold_out`` is ``ordered``, the last rows in id order, or ``hash``, the first in seeded hash order.
    """
    split = {"ordered": split_ordered, "hash": split_exact}[hold_out]
    rows = kept(with_vectors(split(train, 0.3)).select("label", "input", "is_test"))
    evaluator = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction",
                                                  metricName="fMeasureByLabel", metricLabel=1.0)
    drawn = draw_params(trials, seed, space)

    def tried(params: dict[str, float]) -> float:
        model = boosted_trees(**params, seed=seed).fit(rows.filter(~F.col("is_test")))
        return evaluator.evaluate(model.transform(rows.filter("is_test")))

    try:
        with ThreadPool(parallelism) as pool:
            found = pool.map(inheritable_thread_target(train.sparkSession)(tried), drawn)
        best = drawn[max(range(trials), key=lambda i: (found[i], -i))]
        model = Pipeline(stages=[boosted_trees(**best, seed=seed)]).fit(rows)
    finally:
        rows.unpersist()
    return Searched(model, best, found)
