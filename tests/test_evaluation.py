import pytest

from flowscope.operators.evaluation import (
    accuracy,
    best_model,
    confusion_matrix,
    cost_table,
    melt_metrics,
    model_metrics,
    weighted_prf,
)
from flowscope.plans.reports import model_comparison


def pairs(spark, rows):
    return spark.createDataFrame(rows, "model string, label double, prediction double")


HAND = [("m", 0.0, 0.0), ("m", 1.0, 0.0), ("m", 2.0, 2.0)]


def test_metrics_by_hand(spark):
    row = model_metrics(pairs(spark, HAND)).first()
    assert [round(row[c], 4) for c in ("Accuracy", "Precision", "Recall", "F1-Score")] == [
        0.6667, 0.5, 0.6667, 0.5556]
    assert accuracy(pairs(spark, HAND)).first()["accuracy"] == pytest.approx(2 / 3)
    assert weighted_prf(pairs(spark, HAND)).first()["f1"] == pytest.approx(5 / 9)


def test_a_class_only_predicted_has_no_weight(spark):
    row = model_metrics(pairs(spark, [("m", 0.0, 0.0), ("m", 0.0, 5.0)])).first()
    assert (row["Precision"], row["Recall"]) == (1.0, 0.5)


def test_confusion_matrix(spark):
    got = {(r["label"], r["prediction"]): r["n"] for r in confusion_matrix(pairs(spark, HAND)).collect()}
    assert len(got) == 9
    assert {k: n for k, n in got.items() if n} == {(0.0, 0.0): 1, (1.0, 0.0): 1, (2.0, 2.0): 1}
    assert confusion_matrix(pairs(spark, HAND), [0.0, 1.0, 2.0, 3.0]).count() == 16


def test_best_model(spark):
    schema = "Model string, Accuracy double, Precision double, Recall double, `F1-Score` double, pos int"
    df = spark.createDataFrame(
        [("z", 0.0, 0.0, 0.0, 0.9, 0), ("a", 0.0, 0.0, 0.0, 0.9, 1), ("b", 0.0, 0.0, 0.0, 0.1, 2)], schema)
    assert best_model(df, "pos").first()["Model"] == "z"
    assert best_model(df.filter("pos < 0")).count() == 0


def test_melt(spark):
    long = model_comparison(pairs(spark, HAND))
    assert long.columns == ["Model", "Metric", "Score"] and long.count() == 4
    assert melt_metrics(model_metrics(pairs(spark, HAND))).count() == 4


def test_cost_table(spark):
    training = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "Model string, Train_Time_Sec double")
    inference = spark.createDataFrame([("b", 0.1), ("c", 0.2)], "Model string, Inference_Time_Sec double")
    assert [tuple(r) for r in cost_table(training, inference).collect()] == [("b", 2.0, 0.1)]
    assert cost_table(None, inference).columns == ["Model", "Inference_Time_Sec"]
