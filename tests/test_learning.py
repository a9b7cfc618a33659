import pytest
from conftest import at
from pyspark.sql import functions as F

from flowscope import sizing, sources
from flowscope.operators.models import export_winner
from flowscope.plans.learning import learning_run, prepare, scoring_pipeline, train_and_evaluate
from flowscope.schemas import METRICS, MODEL_NAMES, RAW_FLOWS, TRAFFIC_FEATURES
from flowscope.streaming.scoring import emit_metrics, score_flows


@pytest.fixture(scope="module")
def raw(spark):
    """Three classes that the rates tell apart, with copies and unusable rows."""
    rows = spark.range(600).selectExpr(
        "cast(id AS double) AS flow_duration",
        "CASE WHEN id % 3 = 0 THEN 900 WHEN id % 3 = 1 THEN 500 ELSE 10 END + id % 17 * 1.0D AS pkts_per_s",
        "CASE WHEN id % 3 = 0 THEN 90 WHEN id % 3 = 1 THEN 7000 ELSE 10 END + id % 13 * 1.0D AS byts_per_s",
        "id % 29 * 1.0D AS pkt_len_mean", "id % 31 AS byte_count", "id % 37 AS packet_count",
        "1 AS priority", "0 AS table_id", "0 AS hard_timeout", "0 AS idle_timeout", "0 AS flags",
        "CASE WHEN id % 3 = 0 THEN 'ddos' WHEN id % 3 = 1 THEN 'scanning' ELSE 'normal' END AS label")
    bad = rows.limit(5).withColumn("pkts_per_s", F.lit(float("inf")))
    return rows.unionByName(rows.limit(50)).unionByName(bad).select(*RAW_FLOWS.fieldNames())


@pytest.fixture(scope="module")
def trained(raw):
    return train_and_evaluate(raw, Random_Forest={"trees": 10}, Logistic_Regression={"max_iter": 50})


def test_prepare(raw):
    rows, fitted = prepare(raw)
    assert rows.count() == 600
    assert fitted["classes"] == ["ddos", "normal", "scanning"]
    assert sorted(fitted["features"]) == sorted(TRAFFIC_FEATURES)
    shares = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    assert shares == {"train": 480, "test": 120}


def test_prepared_rows_lie_in_parts_of_bounded_size(raw, monkeypatch):
    monkeypatch.setattr(sizing, "ROWS_PER_TASK", 60)
    rows, _ = prepare(raw)
    assert rows.rdd.getNumPartitions() == 10
    assert rows.count() == 600


def test_prepared_rows_are_not_split_again_at_every_pass(raw):
    rows, _ = prepare(raw)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "Join" not in plan


def test_models_beat_the_majority(trained):
    metrics, models, fitted = trained
    scores = {r["Model"]: r for r in metrics.collect()}
    assert set(scores) == set(models) == set(MODEL_NAMES)
    assert all(s["Accuracy"] > 0.9 for s in scores.values())
    cost = fitted["cost"].collect()
    assert {r["Model"] for r in cost} == set(MODEL_NAMES)
    assert all(r["Train_Time_Sec"] > 0 and r["Inference_Time_Sec"] > 0 for r in cost)


def test_winner_is_saved_and_predicts_the_same(spark, trained, raw, tmp_path):
    metrics, models, fitted = trained
    name = export_winner(models, metrics, str(tmp_path / "final"))
    rows, _ = prepare(raw)
    before = models[name].transform(rows).select("prediction").collect()
    after = sources.load_model(str(tmp_path / "final")).transform(rows).select("prediction").collect()
    assert before == after
    with pytest.raises(ValueError):
        export_winner(models, metrics.withColumn("F1-Score", F.lit(0.0)), str(tmp_path / "none"))


def test_a_learning_run_leaves_its_results(spark, raw, tmp_path):
    folder = str(tmp_path / "run")
    name = learning_run(
        raw, folder, Random_Forest={"trees": 10}, Logistic_Regression={"max_iter": 50})
    train, test = sources.load_split(spark, f"{folder}/split")
    assert (train.count(), test.count()) == (480, 120)
    tables = ("training_cost", "model_performance_metrics", "computational_cost")
    for table in tables:
        rows = spark.read.option("header", True).csv(f"{folder}/{table}")
        assert {r["Model"] for r in rows.collect()} == set(MODEL_NAMES)
    # raw rows through the saved preparation and model, and through the saved pipeline
    usable = raw.filter("pkts_per_s < 1e9")
    prepared = sources.load_model(f"{folder}/preparation").transform(usable)
    final = sources.load_model(f"{folder}/final").transform(usable)
    apart = sources.load_model(f"{folder}/models/{name}").transform(prepared)
    assert [r[0] for r in apart.select("prediction").collect()] == [
        r[0] for r in final.select("prediction").collect()]
    assert final.filter("label = predicted_label").count() > 0.9 * usable.count()


def test_score_and_emit(spark, trained, raw, tmp_path):
    _, models, fitted = trained
    pipeline = scoring_pipeline(models["Decision_Tree"], fitted)
    sources.save_model(pipeline, str(tmp_path / "pipeline"))
    pipeline = sources.load_model(str(tmp_path / "pipeline"))

    clean = raw.filter("pkts_per_s < 1e9").withColumn("event_ts", F.lit(at(0)))
    clean.coalesce(1).write.parquet(str(tmp_path / "in"))
    scored = score_flows(spark.read.parquet(str(tmp_path / "in")), pipeline)
    assert scored.filter("label = predicted_label").count() > 0.9 * scored.count()

    stream = spark.readStream.schema(clean.schema).parquet(str(tmp_path / "in"))
    rows = stream.selectExpr(
        "*", "1L AS dpid", "1 AS in_port", "'m' AS eth_src", "80 AS dst_port",
        "pkts_per_s AS pkt_rate", "byts_per_s AS byte_rate", "0.0D AS cpu_percent",
        "label AS scenario")
    query = emit_metrics(rows, pipeline, str(tmp_path / "out"), str(tmp_path / "c"))
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert set(METRICS.fieldNames()) <= set(got.columns)
    assert got.count() == clean.count()
    assert got.filter("(action_taken = 'DROP') != (predicted_label != 'normal')").count() == 0
    assert got.filter("action_taken = 'ALLOW' AND mitigation_latency_ms != 0").count() == 0
    assert got.filter("action_taken = 'DROP' AND mitigation_latency_ms <= 0").count() == 0
