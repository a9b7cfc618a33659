"""Forwarding decisions, kept tables and port rates on streams, against the batch operators."""

import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from flowscope.functions import relative_bin
from flowscope.operators.counters import counter_deltas
from flowscope.operators.packets import drop_lldp, forwarding_decisions, last_known_port, live_devices
from flowscope.operators.telemetry import scenario_t0
from flowscope.schemas import DEVICE_STATE, METRICS, PACKET_IN, TIMING
from flowscope.streaming import packets as sp
from flowscope.streaming.port_rate import PortRates, stream_unique_port_rate
from flowscope.streaming.recorded import stream_recorded_deltas

IP, LLDP = 0x0800, 0x88CC


def append(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def decide(spark, folder, path, **options):
    """Drain what is new, from the checkpoint that the run before left; the query's progress."""
    stream = spark.readStream.schema(PACKET_IN).parquet(folder)
    query = (
        sp.stream_forwarding_decisions(stream, **options).writeStream.format("parquet")
        .option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start(f"{path}/o"))
    assert query.awaitTermination(120)
    return query.recentProgress


def decisions(spark, path):
    return {r["seq"]: (r["event_ts"], r["dpid"], r["in_port"], r["eth_src"], r["eth_dst"], r["out_port"])
            for r in spark.read.parquet(f"{path}/o").collect()}


def batch_decisions(spark, rows):
    return {r["seq"]: (r["event_ts"], r["dpid"], r["in_port"], r["eth_src"], r["eth_dst"], r["out_port"])
            for r in forwarding_decisions(spark.createDataFrame(rows, PACKET_IN)).collect()}


def heartbeat(seconds):
    return (at(seconds), -1, 0, 0, "x", "y", LLDP)


@pytest.mark.parametrize("salts", [1, 4])
def test_decisions_equal_the_batch_with_a_hot_address_and_restarts(spark, tmp_path, salts):
    """Rows out of order within the watermark, in files across restarts; a third ask for one address."""
    rng = random.Random(salts)
    rows = []
    for i in range(600):
        dst = "victim" if i % 3 == 0 else f"h{rng.randrange(30)}"
        src = "victim" if rng.random() < 0.03 else f"h{rng.randrange(30)}"
        port = None if rng.random() < 0.05 else rng.randrange(9)
        eth = LLDP if rng.random() < 0.1 else IP
        rows.append((at(i // 4), i, rng.choice([None, 1, 2]), port, src, dst, eth))
    arrived = sorted(rows, key=lambda r: r[0].timestamp() + rng.random() * 8)
    folder, path = str(tmp_path / "in"), str(tmp_path)
    for i in range(3):
        append(spark, folder, arrived[200 * i:200 * i + 200], PACKET_IN)
        decide(spark, folder, path, salts=salts)
    append(spark, folder, [heartbeat(1_000)], PACKET_IN)
    decide(spark, folder, path, salts=salts)
    got = spark.read.parquet(f"{path}/o")
    assert got.count() == len(rows) - sum(r[6] == LLDP for r in rows)
    assert dict(got.drop("out_port").dtypes) == {f.name: f.dataType.simpleString() for f in PACKET_IN}
    assert decisions(spark, path) == batch_decisions(spark, rows)


def test_late_packets_are_counted_and_teach_nothing(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path)
    rows = [(at(0), 0, 1, 5, "a", "b", IP), (at(100), 1, 1, 6, "c", "a", IP)]
    append(spark, folder, rows, PACKET_IN)
    decide(spark, folder, path)
    # behind the watermark of 90 s: b is not learned, and the question is not answered
    append(spark, folder, [(at(20), 2, 1, 7, "b", "a", IP), (at(101), 3, 1, 6, "c", "b", IP)], PACKET_IN)
    append(spark, folder, [heartbeat(500)], PACKET_IN)
    progress = decide(spark, folder, path)
    assert {k: v[-1] for k, v in decisions(spark, path).items()} == {0: "FLOOD", 1: "5", 3: "FLOOD"}
    assert sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"]) == 2


def test_nothing_is_decided_before_the_watermark(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path)
    append(spark, folder, [(at(0), 0, 1, 5, "a", "b", IP), (at(5), 1, 1, 5, "a", "b", IP)], PACKET_IN)
    decide(spark, folder, path, late="10 seconds")
    assert decisions(spark, path) == {}
    append(spark, folder, [(at(2), 2, 1, 8, "b", "a", IP)], PACKET_IN)  # earlier, but in time
    append(spark, folder, [heartbeat(100)], PACKET_IN)
    decide(spark, folder, path, late="10 seconds")
    assert {k: v[-1] for k, v in decisions(spark, path).items()} == {0: "FLOOD", 1: "8", 2: "5"}


@pytest.mark.parametrize("salts", [1, 3])
def test_waiting_packets_are_blocks_of_the_state(spark, tmp_path, salts):
    """What waits, and the calls for it, go with the groups and not with packets and addresses."""
    rows = [(at(i / 1_000), i, i % 3, i % 9, f"s{i % 400}", f"s{(7 * i) % 500}", IP) for i in range(1_200)]
    folder, path = str(tmp_path / "in"), str(tmp_path)
    append(spark, folder, rows, PACKET_IN)
    waiting = decide(spark, folder, path, salts=salts)[-1]["stateOperators"][0]["numRowsTotal"]
    assert waiting <= 4 * sp.BUCKETS
    append(spark, folder, [heartbeat(1_000)], PACKET_IN)
    decide(spark, folder, path, salts=salts)
    assert decisions(spark, path) == batch_decisions(spark, rows)


@pytest.mark.parametrize("kind", ["ports", "devices"])
def test_kept_tables_equal_the_batch_after_every_batch(spark, tmp_path, kind):
    """Also where the stream is started again, and where a batch is put in twice."""
    rng = random.Random(2)
    if kind == "ports":
        rows = [(at(i), i, rng.randrange(3), rng.randrange(9), f"h{rng.randrange(9)}", "x", rng.choice([IP, LLDP]))
                for i in range(90)]
        schema, keep, table, batch = PACKET_IN, sp.keep_last_known_port, sp.port_table, last_known_port
    else:
        rows = [(at(i), rng.randrange(9), rng.choice(["MAIN", "DEAD"])) for i in range(90)]
        schema, keep, table, batch = DEVICE_STATE, sp.keep_live_devices, sp.device_table, live_devices
    folder, path, seen = str(tmp_path / "in"), str(tmp_path / "t"), []
    for i in range(3):
        append(spark, folder, rows[30 * i:30 * i + 30], schema)
        stream = spark.readStream.schema(schema).parquet(folder)
        assert keep(stream, path, str(tmp_path / "c")).awaitTermination(120) is not False
        kept = table(spark, path).read()
        kept = kept if kind == "ports" else kept.filter("live").select("dpid")
        want = batch(spark.createDataFrame(rows[:30 * i + 30], schema))
        seen.append(sorted(map(tuple, kept.collect())))
        assert seen[-1] == sorted(map(tuple, want.select(*kept.columns).collect()))
        again = spark.createDataFrame([], table(spark, path).schema)
        assert not table(spark, path).upsert(again, table(spark, path).ledger.current().batch_id)
    assert seen[0] != seen[2]


def metric(t, port, scenario="scanning"):
    values = {f.name: None for f in METRICS} | {"timestamp": t, "dst_port": port, "scenario": scenario}
    return tuple(values[f.name] for f in METRICS)


def batch_rates(spark, rows, timing, width):
    metrics = spark.createDataFrame(rows, METRICS).filter("scenario IS NOT NULL AND timestamp IS NOT NULL")
    t0 = scenario_t0(metrics, spark.createDataFrame(timing, TIMING))
    binned = metrics.join(t0, "scenario").withColumn("time_bin", relative_bin(F.col("timestamp") - F.col("t0"), width))
    rates = binned.groupBy("scenario", "time_bin").agg((F.countDistinct("dst_port") / float(width)).alias("r"))
    return sorted(map(tuple, rates.collect()))


def test_port_rate_equals_the_batch_while_scenarios_start(spark, tmp_path):
    """Bins from each scenario's own start, null ports and times, a timing table that grows."""
    rng = random.Random(3)
    rows = [metric(1000.3 + i / 7, rng.choice([None, 80, 443, rng.randrange(50)]), ["scanning", "ddos"][i % 2 * (i > 200)])
            for i in range(420)]
    rows += [metric(None, 3), metric(1000.5, 4, None)]
    timing = [("scanning", 999.1, None), ("ddos", 1028.4, None)]
    folder, rates = str(tmp_path / "in"), PortRates(spark, str(tmp_path / "t"), 2, late_seconds=1000)
    calls = []

    def read_timing():
        calls.append(1)
        return spark.createDataFrame(timing[:len(calls)], TIMING)

    for part in (rows[:200], rows[200:]):
        append(spark, folder, part, METRICS)
        stream = spark.readStream.schema(METRICS).parquet(folder)
        stream_unique_port_rate(stream, read_timing, rates, str(tmp_path / "c")).awaitTermination(120)
        n = rows.index(part[-1]) + 1
        assert sorted(map(tuple, rates.rates().collect())) == batch_rates(spark, rows[:n], timing, 2)
    assert len(calls) == 2 and rates.late_rows() == 0


def test_late_rows_of_closed_bins_are_counted(spark, tmp_path):
    rates = PortRates(spark, str(tmp_path / "t"), 2, late_seconds=10)
    timing = spark.createDataFrame([("scanning", 100.0, None)], TIMING)
    frame = lambda *rows: spark.createDataFrame([metric(*r) for r in rows], METRICS)
    assert rates.update(frame((101.0, 1), (120.0, 2)), timing, 0)
    # the watermark is 110: the bin from 106 to 108 is closed, that from 110 on is not
    late = frame((107.0, 9), (108.5, 9), (110.0, 3), (111.0, 4), (111.5, 4))
    assert rates.update(late, timing, 1)
    assert not rates.update(late, timing, 1)  # run again: neither counted nor added twice
    assert rates.late_rows() == 2
    assert sorted((r["time_bin"], r["ports_per_sec"]) for r in rates.rates().collect()) == [
        (0.0, 0.5), (10.0, 1.0), (20.0, 0.5)]
    # no recorded start: the first event stays the origin, also when an earlier one follows
    assert rates.update(frame((200.0, 1, "ddos")), timing, 2)
    assert rates.update(frame((199.0, 2, "ddos")), timing, 3)
    assert sorted(r["time_bin"] for r in rates.rates().filter("scenario = 'ddos'").collect()) == [-2.0, 0.0]
    assert rates.update(frame(), timing, 4)


def test_discovery_frames_are_not_decided(spark, tmp_path):
    rows = [heartbeat(1), (at(2), 1, 1, 2, "a", "a", IP), heartbeat(50)]
    append(spark, str(tmp_path / "in"), rows, PACKET_IN)
    decide(spark, str(tmp_path / "in"), str(tmp_path))
    assert {k: v[-1] for k, v in decisions(spark, str(tmp_path)).items()} == {1: "2"}
    assert drop_lldp(spark.createDataFrame(rows, PACKET_IN)).count() == 1


def recorded(spark, folders, path, **options):
    """Drain both streams, from the checkpoint that the run before left."""
    polls = spark.readStream.schema("flow_key string, event_ts timestamp, packet_count long, byte_count long, n int").parquet(folders[0])
    control = spark.readStream.schema("event_ts timestamp, on boolean").parquet(folders[1])
    query = (
        stream_recorded_deltas(polls, control, tiebreak="n", **options).writeStream.format("parquet")
        .option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start(f"{path}/o"))
    assert query.awaitTermination(120)


def test_recording_turns_clear_the_state(spark, tmp_path):
    """Off and on between two polls, turns that change nothing, rows out of order, restarts, null flows."""
    rng = random.Random(4)
    poll_schema, control_schema = "flow_key string, event_ts timestamp, packet_count long, byte_count long, n int", "event_ts timestamp, on boolean"
    polls = [(rng.choice(["a", "b", "c", None]), at(i / 3), 2**53 + i * i, rng.choice([None, i]), i) for i in range(360)]
    turns = [(4, True), (30, False), (30.1, True), (41, True), (50, False), (52, False), (60, True), (80, False), (80, True), (110, False)]
    folders, path = (str(tmp_path / "p"), str(tmp_path / "t")), str(tmp_path)
    arrived = sorted(polls, key=lambda r: r[1].timestamp() + rng.random() * 8)
    for i in range(3):
        append(spark, folders[0], arrived[120 * i:120 * i + 120], poll_schema)
        append(spark, folders[1], [(at(t), on) for t, on in turns if 40 * i <= t < 40 * i + 40], control_schema)
        recorded(spark, folders, path, buckets=3)
    append(spark, folders[1], [(at(1_000), False)], control_schema)
    recorded(spark, folders, path, buckets=3)
    windows = [(4, 30), (30.1, 50), (60, 80), (80, 110)]
    sessions = [(*p, i) for p in polls for i, (a, b) in enumerate(windows) if at(a) <= p[1] < at(b)]
    want = counter_deltas(
        spark.createDataFrame(sessions, poll_schema + ", session int"), "flow_key", tiebreak="n", session="session")
    got = spark.read.parquet(f"{path}/o")
    columns = [c for c in want.columns if c in got.columns]
    assert {"n", "dt", "delta_packet_count", "prev_byte_count"} <= set(columns) and got.count() > 200
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
