"""Classification metrics from (model, label, prediction) rows.

Every metric starts from the same small table: one count per model, label and prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.schemas import METRIC_COLUMNS


def pair_counts(pred: DataFrame, by: str = "model") -> DataFrame:
    return pred.groupBy(by, "label", "prediction").agg(F.count("*").alias("n"))


def accuracy(pred: DataFrame, by: str = "model") -> DataFrame:
    hit = (F.col("label") == F.col("prediction")).cast("double")
    return pred.groupBy(by).agg(F.avg(hit).alias("accuracy"))


def _class_scores(counts: DataFrame, by: str) -> DataFrame:
    """Support, precision, recall and F1 per class; a ratio over zero counts as 0."""
    hit = F.col("label") == F.col("prediction")
    sides = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("actual"), F.lit(0).alias("said"),
                 F.when(hit, F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).alias("actual"),
                 F.col("n").alias("said"), F.lit(0).alias("tp")),
    )
    per_class = (
        counts.select(by, F.inline(sides))
        .groupBy(by, "cls")
        .agg(*[F.sum(c).alias(c) for c in ("actual", "said", "tp")])
    )

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    tp = F.col("tp")
    return per_class.select(
        by, "cls", "actual", "tp",
        ratio(tp, F.col("said")).alias("precision"),
        ratio(tp, F.col("actual")).alias("recall"),
        ratio(2 * tp, F.col("said") + F.col("actual")).alias("f1"),
    )


def _weighted(scores: DataFrame, by: str) -> DataFrame:
    support = F.sum("actual")

    def mean(c: str):
        return (F.sum(F.col(c) * F.col("actual")) / support).alias(c)

    return scores.groupBy(by).agg(
        (F.sum("tp") / support).alias("accuracy"), mean("precision"), mean("recall"), mean("f1"))


def weighted_prf(pred: DataFrame, by: str = "model") -> DataFrame:
    """Support-weighted precision, recall and F1."""
    return _weighted(_class_scores(pair_counts(pred, by), by), by).drop("accuracy")


def confusion_matrix(
    pred: DataFrame, classes: list | None = None, by: str = "model"
) -> DataFrame:
    """Counts for every actual x predicted class, zero cells included.

    Without ``classes`` they are the sorted classes seen in a model's rows.
    """
    counts = pair_counts(pred, by)
    if classes is None:
        seen = F.array_union(F.collect_set("label"), F.collect_set("prediction"))
    else:
        seen = F.first(F.array(*[F.lit(c) for c in sorted(classes)]))
    cells = (
        counts.groupBy(by).agg(F.array_sort(seen).alias("classes"))
        .select(by, "classes", F.explode("classes").alias("label"))
        .select(by, "label", F.explode("classes").alias("prediction"), F.lit(0).alias("n"))
    )
    filled = counts.unionByName(cells).groupBy(by, "label", "prediction")
    return filled.agg(F.sum("n").alias("n"))


def model_metrics(pred: DataFrame, by: str = "model") -> DataFrame:
    """One row of weighted metrics per model."""
    rows = _weighted(_class_scores(pair_counts(pred, by), by), by)
    names = ["accuracy", "precision", "recall", "f1"]
    renamed = [F.col(a).alias(b) for a, b in zip(names, METRIC_COLUMNS)]
    return rows.select(F.col(by).alias("Model"), *renamed)


def best_model(metrics: DataFrame, pos: str = "Model") -> DataFrame:
    """The model with the highest positive F1; of equals the one first in ``pos``."""
    scored = metrics.filter(F.col("F1-Score") > 0)
    return scored.orderBy(F.desc("F1-Score"), F.asc(pos)).limit(1)


def melt_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.unpivot("Model", METRIC_COLUMNS, "Metric", "Score")


def cost_table(training: DataFrame | None, inference: DataFrame) -> DataFrame:
    """Training and inference seconds per model; inference alone without a training table."""
    if training is None:
        return inference
    return training.join(inference, "Model")
