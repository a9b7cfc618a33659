from types import SimpleNamespace

import pytest
from conftest import at
from pyspark.sql import functions as F

from flowscope import sources
from flowscope.schemas import CSV_HEADERS, FLOW_STATS, METRICS, RAW_FLOWS
from flowscope.sources.files import MalformedRowsError, read_raw_flows, split_raw_flows
from flowscope.sizing import local_scratch, scratch_dir, shared_dir, small_or_same, small_rows, stored

ROW = (1.5, 20.0, 2000.0, 100.0, 3000, 30, 1, 0, 0, 0, 0, "ddos")


def raw(spark, n=2):
    return spark.createDataFrame([ROW] * n, RAW_FLOWS)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_raw_flows_round_trip(spark, tmp_path, fmt):
    path = str(tmp_path / "raw")
    sources.append_raw_flows(raw(spark), path, fmt)
    sources.append_raw_flows(raw(spark, 1), path, fmt)
    got = sources.read_raw_flows(spark, path, fmt)
    assert [f.name for f in got.schema] == RAW_FLOWS.fieldNames()
    assert [tuple(r) for r in got.collect()] == [ROW] * 3


def test_missing_text_and_numbers(spark, tmp_path):
    lines = [",".join(CSV_HEADERS.values())]
    for first, label in (("NaN", "ddos"), ("1.0", "NA"), ("1.0", "null"), ("inf", "ddos"), ("2.0", "ddos")):
        lines.append(f"{first},1,1,1,1,1,1,0,0,0,0,{label}")
    (tmp_path / "raw.csv").write_text("\n".join(lines) + "\n")
    got = sources.read_raw_flows(spark, str(tmp_path / "raw.csv"))
    assert [r["label"] for r in got.collect()] == ["ddos", None, None, "ddos", "ddos"]
    from flowscope.operators.cleaning import clean

    assert [r["flow_duration"] for r in clean(got).collect()] == [2.0]


def test_missing_inputs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.read_raw_flows(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        sources.load_split(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        sources.load_model(str(tmp_path / "none"))
    assert sources.read_metrics_timing(spark, str(tmp_path)) == (None, None)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_metrics_and_timing(spark, tmp_path, fmt):
    row = {f.name: None for f in METRICS} | {
        "timestamp": 5.0, "dpid": 1, "pkt_rate": 0.125, "byte_rate": 1.0, "inference_time_ms": 0.0625,
        "mitigation_latency_ms": 0.0, "cpu_percent": 12.345, "scenario": "ddos", "action_taken": "DROP"}
    events = spark.createDataFrame([tuple(row[f.name] for f in METRICS)], METRICS)
    sources.append_metrics(events, str(tmp_path / "metrics"), fmt)
    metrics, timing = sources.read_metrics_timing(spark, str(tmp_path), fmt)
    got = metrics.first()
    assert (got["pkt_rate"], got["inference_time_ms"], got["scenario"]) == (0.12, 0.062, "ddos")
    assert got["eth_src"] is None and timing.count() == 0

    sources.append_timing(spark, str(tmp_path / "timing"), "ddos", 3.0, fmt=fmt)
    sources.append_timing(spark, str(tmp_path / "timing"), "scanning", 4.0, 2.0, fmt=fmt)
    _, timing = sources.read_metrics_timing(spark, str(tmp_path), fmt)
    assert sorted(map(tuple, timing.collect())) == [("ddos", 3.0, None), ("scanning", 4.0, 2.0)]


def test_rows_are_stamped_now(spark):
    import time

    df = spark.createDataFrame([tuple(None for _ in METRICS)], METRICS).drop("timestamp")
    assert abs(sources.metric_rows(df).first()["timestamp"] - time.time()) < 60


def test_split_round_trip(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("test"))
    sources.save_split(df, str(tmp_path / "split"))
    train, test = sources.load_split(spark, str(tmp_path / "split"))
    assert (train.count(), test.count()) == (8, 2)
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().toString()


def test_flow_stats_batch_and_result(spark, tmp_path):
    stats = spark.createDataFrame([(at(0), 1, 0, {"a": "b"}, 1, 10, 1, 0, 1, 0, 0, 0)], FLOW_STATS)
    stats.write.parquet(str(tmp_path / "stats"))
    assert sources.read_flow_stats(spark, str(tmp_path / "stats")).schema == FLOW_STATS
    sources.write_result(spark.range(3), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_size_checks(spark, tmp_path):
    df = spark.range(10)
    assert small_rows(df, 9) is None and small_rows(df, 10).num_rows == 10
    assert small_or_same(df, 9) is df
    local = small_or_same(df, 10)
    assert "LocalTableScan" in local._jdf.queryExecution().executedPlan().toString()
    big = spark.range(1_000_000).withColumnRenamed("id", "k")
    plan = big.join(local, big.k == local.id)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_scratch_is_under_the_shared_folder(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    path = scratch_dir(spark, "t")
    if base:
        assert path.startswith(base.rstrip("/") + "/")
    assert path != scratch_dir(spark, "t")
    assert stored(spark.range(5)).count() == 5


def test_no_scratch_without_a_shared_folder():
    bare = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(getConf=dict, master="spark://host"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(bare)
    local_scratch(bare)
    assert bare.conf == {}


def test_malformed_rows_are_set_apart(spark, tmp_path):
    """Letters in numbers, missing and extra fields; missing values are no fault of a row."""
    names = list(CSV_HEADERS.values())
    good = ["0.5,1.0,2.0,3.0,10,20,1,0,0,0,3,ddos", "NA,1.0,2.0,3.0,10,20,1,0,0,0,3,normal",
            "0.5,nan,Infinity,3.0,10,,1,0,0,0,3,NA", ",,,,,,,,,,,"]
    bad = ["0.5x,1.0,2.0,3.0,10,20,1,0,0,0,3,ddos", "0.5,1.0,2.0,3.0,10.5,20,1,0,0,0,3,ddos",
           "0.5,1.0,2.0", "0.5,1.0,2.0,3.0,10,20,1,0,0,0,3,ddos,more", "NA", "?,?,?,?,?,?,?,?,?,?,?,?"]
    (tmp_path / "a.csv").write_text("\n".join([",".join(names), *good[:2], *bad[:3]]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([",".join(names), *good[2:], *bad[3:]]) + "\n")
    rows, malformed = split_raw_flows(spark, str(tmp_path))
    assert rows.schema == RAW_FLOWS
    assert sorted(r["line"] for r in malformed.collect()) == sorted(bad)
    found = sorted(map(str, rows.collect()))
    assert len(found) == len(good) and sum("None" not in r for r in found) == 1
    # the lenient reader sees the same good rows
    assert set(found) <= set(map(str, read_raw_flows(spark, str(tmp_path)).collect()))
    assert split_raw_flows(spark, str(tmp_path), most=6)[1].count() == 6
    with pytest.raises(MalformedRowsError, match="6 malformed rows"):
        split_raw_flows(spark, str(tmp_path), most=5)
    with pytest.raises(FileNotFoundError):
        split_raw_flows(spark, str(tmp_path / "none"))
