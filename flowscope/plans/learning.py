"""Labelled dataset to trained, compared and exported classifiers."""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import IndexToString, SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators.cleaning import clean, traffic_columns
from flowscope.operators.evaluation import confusion_matrix, cost_table, model_metrics
from flowscope.operators.features import (
    apply_scaler,
    assemble,
    class_list,
    encode_label,
    fit_scaler,
    forest_importance,
    stratified_split,
    top_features,
)
from flowscope.operators.models import inference_cost, predict_all, training_cost, winner
from flowscope.schemas import IDENTITY, N_FEATURES
from flowscope.sizing import dealt, stored
from flowscope.sources import save_model, save_split, write_result


def scaling_stages(stats: DataFrame, features: list[str]) -> list:
    """The fitted scaler and the assembler as pipeline stages that can be saved."""
    fitted = {s["column"]: s for s in stats.collect()}
    exprs = [
        f"(`{c}` - {fitted[c]['mean']!r}D) / {fitted[c]['std']!r}D AS `{c}_scaled`"
        for c in features
    ]
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}_scaled" for c in features], outputCol="features"),
    ]


def prepare(
    raw: DataFrame, n_features: int = N_FEATURES, key: str | None = None
) -> tuple[DataFrame, dict]:
    """Clean, encode, split, select and scale.

    Returns the rows with ``split``, ``label_index`` and ``features``, and the fitted
    ``classes``, ``features`` and ``scaler``. The encoder sees all rows; selection and
    scaling are fitted on train only.
    """
    # several passes follow: the shuffle that removes copies must not be run for each.
    # Metadata takes part in cleaning and in the split, and is dropped afterwards
    cleaned = stored(clean(raw.drop(*IDENTITY), key))
    classes = class_list(cleaned)
    # nor the hashes of whole rows that the split goes by
    rows = traffic_columns(stratified_split(encode_label(cleaned, classes), "label", key=key))
    rows = stored(dealt(rows, cleaned.count()))
    columns = [c for c in rows.columns if c not in ("label", "label_index", "split", key)]

    train = rows.filter(F.col("split") == "train")
    importances = forest_importance(train, columns)
    selected = [r["feature"] for r in top_features(importances, n_features).collect()]
    scaler = train.sparkSession.createDataFrame(
        fit_scaler(train, selected).toArrow(), "column string, mean double, std double")
    scaled = assemble(apply_scaler(rows, scaler), selected)
    return scaled.select("split", "label", "label_index", "features"), {
        "classes": classes, "features": selected, "scaler": scaler,
        "importances": importances,
    }


def train_and_evaluate(
    raw: DataFrame, key: str | None = None, **options: dict
) -> tuple[DataFrame, dict[str, Model], dict]:
    """Train the three models and compare them on the held-out rows.

    Returns the metrics table, the models, and the fitted preparation with the prepared
    ``rows``, the ``training`` seconds, the ``cost`` table and the ``predictions``.
    """
    rows, fitted = prepare(raw, key=key)
    train = rows.filter(F.col("split") == "train")
    test = rows.filter(F.col("split") == "test")
    training, models = training_cost(train, **options)
    inference = inference_cost(models, test)
    # metrics and matrices read them, and the models need not predict again
    fitted["predictions"] = stored(predict_all(models, test))
    fitted["rows"], fitted["training"] = rows, training
    fitted["cost"] = cost_table(training, inference)
    return model_metrics(fitted["predictions"]), models, fitted


def learning_run(raw: DataFrame, folder: str, key: str | None = None, **options: dict) -> str:
    """Train, compare and leave every result under ``folder``; returns the winner's name.

    ``split`` holds the prepared rows, ``models/<name>`` each model, ``preparation`` the fitted
    scaler and assembler, and ``final`` the winner as a pipeline that scores raw rows. The
    tables are ``training_cost``, ``model_performance_metrics``, ``computational_cost`` and
    ``confusion_matrix``.
    """
    metrics, models, fitted = train_and_evaluate(raw, key, **options)
    name = winner(models, metrics)
    save_split(fitted["rows"], f"{folder}/split")
    tables = {
        "training_cost": fitted["training"], "model_performance_metrics": metrics,
        "computational_cost": fitted["cost"],
        "confusion_matrix": confusion_matrix(fitted["predictions"]),
    }
    for table, rows in tables.items():
        write_result(rows, f"{folder}/{table}")
    for model_name, model in models.items():
        save_model(model, f"{folder}/models/{model_name}")
    stages = scaling_stages(fitted["scaler"], fitted["features"])
    save_model(PipelineModel(stages), f"{folder}/preparation")
    save_model(scoring_pipeline(models[name], fitted), f"{folder}/final")
    return name


def scoring_pipeline(model: Model, fitted: dict) -> PipelineModel:
    """Raw feature columns to ``predicted_label``, as one model to save and load."""
    names = IndexToString(
        inputCol="prediction", outputCol="predicted_label", labels=fitted["classes"])
    return PipelineModel([*scaling_stages(fitted["scaler"], fitted["features"]), model, names])
