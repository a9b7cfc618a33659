import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from flowscope import sources
from flowscope.operators.packets import last_known_port, live_devices
from flowscope.operators.counters import counter_deltas, flow_features
from flowscope.plans.capture import capture, rated, with_flow_key
from flowscope.schemas import DEVICE_STATE, FLOW_STATS, METRICS, PACKET_IN, RECORDING_WINDOWS, SCENARIO_LOG
from flowscope.streaming.counters import (
    batch_folder,
    label_batches,
    stream_capture,
    stream_counter_deltas,
    stream_port_rate,
)
from flowscope.streaming.scoring import decide_action


def polls(rng, first, last, flows=4):
    return [
        (at(t + rng.random() / 10), 1, 0, {"u": str(f)}, rng.randrange(50), rng.randrange(9000), t, 0, 1, 0, 0, 0)
        for t in range(first, last) for f in range(flows)]


def write_batches(spark, path, batches, schema):
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)


def drain(spark, stream, path, mode="append"):
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/c")
        .outputMode(mode).trigger(availableNow=True).start(f"{path}/o"))
    assert query.awaitTermination(120)
    return spark.read.schema(stream.schema).parquet(f"{path}/o")


@pytest.fixture(scope="module")
def recorded(spark, tmp_path_factory):
    rng = random.Random(1)
    folder = str(tmp_path_factory.mktemp("stats"))
    write_batches(spark, folder, [polls(rng, 0, 8), polls(rng, 8, 16), polls(rng, 16, 24)], FLOW_STATS)
    return folder


@pytest.mark.parametrize("tiebreak", [None, "flags"])
def test_stream_capture_equals_batch_while_control_tables_grow(spark, recorded, tmp_path, tiebreak):
    """The second recording and scenario begin after the query; the first window closes late."""
    windows = [(1, at(2), at(10)), (2, at(12), None)]
    log = [("ddos", at(5), 1), ("scanning", at(14), 2)]
    seen = []

    def read_windows():
        seen.append(1)
        now = [(1, at(2), None)] if len(seen) == 1 else windows
        return spark.createDataFrame(now, RECORDING_WINDOWS)

    def read_log():
        return spark.createDataFrame(log[:len(seen)], SCENARIO_LOG)

    stream = sources.read_flow_stats(spark, recorded, streaming=True, files_per_trigger=1)
    query = stream_capture(
        stream, read_log, read_windows, batch_folder(str(tmp_path / "o")), str(tmp_path / "c"),
        tiebreak=tiebreak, ttl_seconds=None)
    assert query.awaitTermination(120) and len(seen) == 3
    got = spark.read.parquet(str(tmp_path / "o")).drop("batch_id")
    want = capture(
        sources.read_flow_stats(spark, recorded), spark.createDataFrame(log, SCENARIO_LOG),
        spark.createDataFrame(windows, RECORDING_WINDOWS), tiebreak=tiebreak)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.count() > 50


def test_large_counters_and_a_clock_change(spark, tmp_path):
    """Counters above 2^53 with nulls among them, across the end of summer time."""
    start = 1_699_162_800  # 2023-11-05 05:40 UTC, 20 minutes before New York turns back
    rows = [(start + i * 1200, 2**53 + 1 + 2 * i, None if i == 2 else 2**60 + i) for i in range(5)]
    folder = str(tmp_path / "in")
    frame = spark.createDataFrame(rows, "s long, packet_count long, byte_count long").selectExpr(
        "'k' AS flow_key", "timestamp_seconds(s) AS event_ts", "packet_count", "byte_count")
    for part in ("packet_count < 9007199254740998", "packet_count >= 9007199254740998"):
        frame.filter(part).coalesce(1).write.mode("append").parquet(folder)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        got = drain(spark, stream_counter_deltas(stream, "flow_key", ttl_seconds=None), str(tmp_path))
        want = counter_deltas(spark.read.parquet(folder), "flow_key")
        columns = ["dt", "delta_packet_count", "delta_byte_count", "prev_byte_count"]
        rows = [sorted(map(str, df.select(*columns).collect())) for df in (got, want)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert rows[0] == rows[1] and len(rows[0]) == 4


def test_older_samples_are_ignored(spark, tmp_path):
    poll = lambda t, n: (at(t), 1, 0, {"u": "1"}, n, n, 0, 0, 1, 0, 0, 0)
    folder = str(tmp_path / "in")
    write_batches(spark, folder, [[poll(0, 1), poll(5, 2)], [poll(3, 9)], [poll(6, 4)]], FLOW_STATS)
    stream = with_flow_key(sources.read_flow_stats(spark, folder, True, files_per_trigger=1))
    got = drain(spark, stream_counter_deltas(stream, "flow_key", ttl_seconds=None), str(tmp_path))
    assert [(r["dt"], r["delta_packet_count"]) for r in got.orderBy("event_ts").collect()] == [
        (5.0, 1), (1.0, 2)]


def test_a_long_log_is_refused_on_streams_but_works_per_batch(spark, recorded):
    from flowscope.operators.intervals import label_by_scenario

    log = spark.range(20).selectExpr(
        "'ddos' AS scenario", "timestamp_seconds(id) AS start_ts", "id AS seq")
    stream = sources.read_flow_stats(spark, recorded, streaming=True)
    with pytest.raises(ValueError, match="foreachBatch"):
        label_by_scenario(stream, log, small_log=10)
    batch = sources.read_flow_stats(spark, recorded)
    assert label_by_scenario(batch, log, small_log=10).filter("label = 'ddos'").count() == batch.count()


def test_a_growing_log(spark, recorded, tmp_path):
    calls = []

    def read_log():
        # a change is written between the first and the second micro-batch
        calls.append(1)
        rows = [("ddos", at(4), 1), ("scanning", at(12), 2)][:len(calls)]
        return spark.createDataFrame(rows, SCENARIO_LOG)

    stream = sources.read_flow_stats(spark, recorded, streaming=True, files_per_trigger=1)
    query = label_batches(stream, read_log, str(tmp_path / "o"), str(tmp_path / "c"))
    assert query.awaitTermination(120) and len(calls) == 3
    got = spark.read.parquet(str(tmp_path / "o")).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"normal": 16, "ddos": 32, "scanning": 48}


def test_raw_flow_sink(spark, recorded, tmp_path):
    stream = with_flow_key(sources.read_flow_stats(spark, recorded, True))
    deltas = stream_counter_deltas(stream, "flow_key", ttl_seconds=None)
    rows = flow_features(rated(deltas).withColumn("label", F.lit("normal")))
    query = sources.append_raw_flows(rows, str(tmp_path / "raw"), checkpoint=str(tmp_path / "c"))
    assert query.awaitTermination(120)
    want = rated(counter_deltas(with_flow_key(sources.read_flow_stats(spark, recorded)), "flow_key"))
    assert sources.read_raw_flows(spark, str(tmp_path / "raw")).count() == want.count() > 0


@pytest.mark.parametrize("table", ["ports", "devices"])
def test_keyed_state_on_streams(spark, tmp_path, table):
    if table == "ports":
        rows = [(at(i), i, i % 2, i % 3, f"h{i % 4}", "x", 0x0800) for i in range(40)]
        schema, apply = PACKET_IN, last_known_port
    else:
        rows = [(at(i), i % 4, "MAIN" if i % 7 else "DEAD") for i in range(40)]
        schema, apply = DEVICE_STATE, live_devices
    folder = str(tmp_path / "in")
    write_batches(spark, folder, [rows[:20], rows[20:]], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    seen = []
    query = (
        apply(stream).writeStream.outputMode("complete")
        .foreachBatch(lambda df, i: seen.append(sorted(map(tuple, df.collect()))))
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    assert query.awaitTermination(120)
    assert seen[-1] == sorted(map(tuple, apply(spark.createDataFrame(rows, schema)).collect()))


def test_stream_port_rate(spark, tmp_path):
    empty = {f.name: None for f in METRICS}
    rows = [tuple({**empty, "timestamp": float(t), "dst_port": p}[f.name] for f in METRICS)
            for t, p in ((0, 80), (1, 80), (1, 443), (2, 22), (500, 1))]
    folder = str(tmp_path / "in")
    write_batches(spark, folder, [rows, rows[-1:]], METRICS)
    stream = spark.readStream.schema(METRICS).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drain(spark, stream_port_rate(stream), str(tmp_path))
    assert sorted(r["ports_per_sec"] for r in got.collect()) == [0.5, 1.0]


def test_decide_action(spark):
    df = spark.createDataFrame([("normal",), ("ddos",)], "predicted_label string")
    assert [r["action_taken"] for r in decide_action(df).collect()] == ["ALLOW", "DROP"]


class _Kept:
    """State of one group, and a clock; counts reads and writes."""

    def __init__(self):
        self.value, self.calls, self.now = None, [], 0

    def getValueState(self, name, schema, ttl_ms=None):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def getCurrentProcessingTimeInMs(self):
        return self.now


def _samples(ttl_ms=None, tie="long"):
    import pandas as pd
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    from flowscope.streaming import previous_sample as ps

    fields = T.StructType.fromDDL(f"ts long, tie {tie}, n long, x double")
    rows = to_arrow_schema(T.StructType([*fields.fields, T.StructField(ps.FLOW, T.StringType())]))
    kept = _Kept()
    out = [*fields.fieldNames(), *[f"prev_{c}" for c in fields.fieldNames()]]
    processor = ps.PreviousSamples(rows, ["ts", "tie"], fields, out, ttl_ms)
    processor.init(kept)

    def batch(*samples):
        import pyarrow as pa

        table = pa.Table.from_pylist([dict(zip(rows.names, r)) for r in samples], rows)
        dealt = table.append_column(ps.BUCKET, pa.array([7] * len(samples), pa.int32())).to_batches()
        frames = [b.to_pandas() for b in ps.blocks(rows)(iter(dealt))]
        found = list(processor.handleInputRows((7,), iter(frames), kept))
        return sorted((r.n, None if r.prev_n == ps.MISSING else r.prev_n, None if pd.isna(r.prev_x) else r.prev_x)
                      for f in found for r in f.itertuples())

    return batch, kept


def test_samples_of_many_keys_are_differenced_at_once():
    batch, kept = _samples()
    assert batch((5, 0, 51, 0.5, "a"), (3, 0, 31, None, "b"), (1, 0, 11, 0.1, "a")) == [
        (11, None, None), (31, None, None), (51, 11, 0.1)]
    # older by time, older by tiebreak, equal, a new key; b stays
    assert batch((4, 9, 41, 1.0, "a"), (5, -1, 50, 1.0, "a"), (5, 0, 52, 1.0, "a"), (1, 1, 2**60 + 1, 1.0, "c")) == [
        (52, 51, 0.5), (2**60 + 1, None, None)]
    assert batch((4, 0, 42, 1.0, "b"), (6, 0, 61, 1.0, "c")) == [(42, 31, None), (61, 2**60 + 1, 1.0)]
    assert kept.calls == ["update", "get", "update", "get", "update"]


def test_samples_with_text_as_tiebreak():
    batch, _ = _samples(tie="string")
    assert batch((1, "b", 2, 1.0, "a"), (1, None, 1, 1.0, "a")) == [(1, None, None), (2, 1, 1.0)]
    assert batch((1, "a", 3, 1.0, "a"), (1, None, 4, 1.0, "a"), (1, "c", 5, 1.0, "a")) == [(5, 2, 1.0)]


def test_state_of_each_key_lives_as_long_as_it_is_renewed():
    batch, kept = _samples(ttl_ms=100)
    batch((1, 0, 1, 1.0, "a"), (1, 0, 2, 1.0, "b"))
    kept.now = 60
    assert batch((2, 0, 3, 1.0, "a")) == [(3, 1, 1.0)]
    kept.now = 100
    assert batch((3, 0, 4, 1.0, "a"), (3, 0, 5, 1.0, "b")) == [(4, 3, 1.0), (5, None, None)]


def test_keys_of_several_parts_and_nulls(spark, tmp_path):
    rows = [(None if i % 3 == 0 else f"{i % 3}", None if i % 2 else i % 4, float(i % 5 // 2), at(i), i, i * i) for i in range(40)]
    frame = spark.createDataFrame(rows, "a string, b int, c double, event_ts timestamp, packet_count long, byte_count long")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    columns = ["a", "b", "c", "packet_count", "dt", "delta_packet_count"]
    got = drain(spark, stream_counter_deltas(stream, ["a", "b", "c"], ttl_seconds=None), str(tmp_path))
    want = counter_deltas(frame, ["a", "b", "c"])
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


@pytest.mark.parametrize("name", ["stream_counter_deltas", "stream_capture"])
def test_files_of_one_step_may_be_in_any_order(spark, tmp_path, name):
    """A flow's polls lie in four files, the newest first; none of them is too late."""
    from flowscope import registry

    kinds = ["signup", "view", "error", "click"]
    rows = [(i, i * 600, i % 5, kinds[i % 4], i * 0.5, f'{{"k": {i % 97}}}') for i in range(200)]
    table = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    table = table.selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type", "value", "props")
    for part in (3, 2, 1, 0):
        table.filter(f"pmod(event_id * 7, 4) = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    found = registry.queries()
    twin = {"stream_counter_deltas": "counter_deltas", "stream_capture": "capture"}[name]
    got, want = found[name](spark, str(tmp_path)), found[twin](spark, str(tmp_path))
    columns = [c for c in got.columns if c in want.columns]
    assert "flow_key" in columns or "delta_packet_count" in columns
    rows = [sorted(map(str, df.select(*columns).collect())) for df in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) > 50
