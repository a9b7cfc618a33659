"""The three classifiers, prediction and their cost tables."""

from __future__ import annotations

import time

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators.evaluation import best_model
from flowscope.operators.features import MAX_DEPTH, balanced_weights
from flowscope.operators.forests import Forest
from flowscope.schemas import FOREST_TREES, LOGISTIC_ITERATIONS, MODEL_NAMES, SEED
from flowscope.sources.artifacts import save_model

LABEL = "label_index"


def train_logistic(train: DataFrame, max_iter: int = LOGISTIC_ITERATIONS) -> Model:
    """Multinomial, with the penalty that a unit inverse strength gives on the summed loss."""
    rows = train.count()
    return LogisticRegression(
        featuresCol="features", labelCol=LABEL, maxIter=max_iter, family="multinomial",
        regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False, tol=1e-4,
    ).fit(train)


def train_tree(train: DataFrame, seed: int = SEED, max_depth: int = MAX_DEPTH) -> Model:
    """One tree over all rows and features; as a forest's, its lower parts are a table."""
    return Forest(train, 1, seed, max_depth, LABEL, single=True).model()


def train_forest(
    train: DataFrame, trees: int = FOREST_TREES, seed: int = SEED, max_depth: int = MAX_DEPTH
) -> Model:
    """Forest with class weights that balance the classes."""
    return Forest(balanced_weights(train, LABEL), trees, seed, max_depth, LABEL, weight="weight").model()


def training_cost(train: DataFrame, **options: dict) -> tuple[DataFrame, dict[str, Model]]:
    """Fit the three models in fixed order; their wall seconds and the models.

    ``options`` maps a model name to keyword arguments of its trainer.
    """
    trainers = dict(zip(MODEL_NAMES, [train_logistic, train_tree, train_forest]))
    cached = train.select("features", LABEL).persist()
    cached.count()
    seconds, models = [], {}
    for name, fit in trainers.items():
        begin = time.monotonic()
        models[name] = fit(cached, **options.get(name, {}))
        seconds.append((name, time.monotonic() - begin))
    cached.unpersist()
    table = train.sparkSession.createDataFrame(seconds, "Model string, Train_Time_Sec double")
    return table, models


def predict(model: Model, df: DataFrame) -> DataFrame:
    return model.transform(df)


def predict_all(models: dict[str, Model], df: DataFrame) -> DataFrame:
    """(model, label, prediction) rows of every model."""
    parts = [
        predict(m, df).select(
            F.lit(name).alias("model"), F.col(LABEL).alias("label"), "prediction")
        for name, m in models.items()
    ]
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    return everything


def inference_cost(models: dict[str, Model], test: DataFrame) -> DataFrame:
    """Wall seconds each model takes to predict all of ``test``."""
    cached = test.persist()
    cached.count()
    seconds = []
    for name, model in models.items():
        begin = time.monotonic()
        predict(model, cached).select("prediction").write.format("noop").mode("overwrite").save()
        seconds.append((name, time.monotonic() - begin))
    cached.unpersist()
    return test.sparkSession.createDataFrame(seconds, "Model string, Inference_Time_Sec double")


def winner(models: dict[str, Model], metrics: DataFrame) -> str:
    """Name of the best model; of equals the one first in ``models``."""
    order = F.array_position(F.array(*[F.lit(n) for n in models]), F.col("Model"))
    best = best_model(metrics.withColumn("_pos", order), "_pos").collect()
    if not best:
        raise ValueError("no model scored above 0, so there is none to export")
    return best[0]["Model"]


def export_winner(models: dict[str, Model], metrics: DataFrame, path: str) -> str:
    """Save the best model under ``path`` and return its name."""
    name = winner(models, metrics)
    save_model(models[name], path)
    return name
