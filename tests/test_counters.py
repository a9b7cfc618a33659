import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from flowscope.functions import flow_duration, flow_key
from flowscope.operators.counters import counter_deltas, flow_features, min_gap
from flowscope.operators.intervals import label_by_scenario, within_recording
from flowscope.operators.ordered import time_cuts
from flowscope.plans.capture import capture, rated
from flowscope.schemas import CSV_HEADERS, FLOW_STATS, RECORDING_WINDOWS, SCENARIO_LOG

# the hand-computed flow of FIXTURES.md
SAMPLES = [(0, 10, 1000), (1.0, 30, 3000), (1.05, 40, 4000), (2.05, 5, 500), (3.05, 5, 700)]


def samples(spark, rows=SAMPLES, key="f"):
    data = [(key, at(t), p, b, i) for i, (t, p, b) in enumerate(rows)]
    return spark.createDataFrame(
        data, "flow_key string, event_ts timestamp, packet_count long, byte_count long, seq long")


def rate_rows(df):
    return [tuple(r) for r in df.orderBy("seq").select(
        "seq", "pkts_per_s", "byts_per_s", "pkt_len_mean").collect()]


@pytest.mark.parametrize("rows_per_chunk", [1, 1_000_000])
def test_rates_by_hand(spark, rows_per_chunk):
    got = rated(counter_deltas(
        samples(spark), "flow_key", tiebreak="seq", rows_per_chunk=rows_per_chunk))
    assert rate_rows(got) == [(1, 20.0, 2000.0, 100.0), (3, 0.0, 0.0, 0.0), (4, 0.0, 200.0, 200.0)]


def test_short_gap_still_becomes_the_previous_sample(spark):
    deltas = counter_deltas(samples(spark), "flow_key").orderBy("seq").collect()
    assert [r["prev_packet_count"] for r in deltas] == [10, 30, 40, 5]
    assert [r["seq"] for r in min_gap(counter_deltas(samples(spark), "flow_key"))
            .orderBy("seq").collect()] == [1, 3, 4]


def test_two_rules_of_one_key_in_one_reply(spark):
    rows = samples(spark, [(0, 1, 10), (0, 7, 70), (1, 9, 90)])
    got = rated(counter_deltas(rows, "flow_key", tiebreak="seq"))
    assert rate_rows(got) == [(2, 2.0, 20.0, 10.0)]


def test_idle_flow_emits_nothing(spark):
    assert rated(counter_deltas(samples(spark, [(0, 0, 0), (1, 0, 0)]), "flow_key")).count() == 0


def test_chunks_do_not_change_the_result(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        # one key holds a third of all rows, others are rare and skip many chunks
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(400)}"
        rows.append((key, at(rng.randrange(0, 40 * 3600)), rng.randrange(100), rng.randrange(9000), i))
    df = spark.createDataFrame(
        rows, "flow_key string, event_ts timestamp, packet_count long, byte_count long, seq long")
    cols = ["seq", "dt", "delta_packet_count", "delta_byte_count"]

    def result(n):
        got = counter_deltas(df, "flow_key", tiebreak="seq", rows_per_chunk=n)
        return sorted(map(tuple, got.select(*cols).collect()))

    last, expected = {}, []
    for key, ts, p, b, seq in sorted(rows, key=lambda r: (r[1], r[4])):
        if key in last:
            t0, p0, b0 = last[key]
            expected.append((seq, (ts - t0).total_seconds(), p - p0, b - b0))
        last[key] = (ts, p, b)
    assert result(10**9) == sorted(expected)
    assert result(100) == sorted(expected)


def test_crowded_minutes_are_cut_finer(spark):
    # a third of all rows fall into one second
    times = [30 + i / 1000 for i in range(500)] + [60 * i for i in range(1000)]
    df = spark.createDataFrame([(at(t),) for t in times], "ts timestamp")
    cuts = time_cuts(df, "ts", 100)
    stamps = sorted(int(at(t).timestamp() * 1e6) for t in times)
    assert cuts == sorted(set(cuts))
    edges = [stamps[0], *cuts, stamps[-1] + 1]
    sizes = [sum(a <= s < b for s in stamps) for a, b in zip(edges, edges[1:])]
    assert sum(sizes) == len(times) and max(sizes) <= 220
    assert time_cuts(df, "ts", 10_000) == []


def test_recording_filter_reaches_the_scan(spark, tmp_path):
    stats = spark.createDataFrame([(at(0), 1, 0, {}, 1, 1, 1, 0, 1, 0, 0, 0)], FLOW_STATS)
    stats.write.parquet(str(tmp_path / "s"))
    windows = spark.createDataFrame([(1, at(10), at(20))], RECORDING_WINDOWS)
    kept = within_recording(spark.read.schema(FLOW_STATS).parquet(str(tmp_path / "s")), windows)
    assert "GreaterThanOrEqual(event_ts" in kept._jdf.queryExecution().executedPlan().toString()


def test_flow_key_ignores_match_order(spark):
    df = spark.sql("""
        SELECT 1L AS d, 0 AS t, map('a', '1', 'b', '2') AS m
        UNION ALL SELECT 1L, 0, map('b', '2', 'a', '1')
        UNION ALL SELECT 1L, 1, map('a', '1', 'b', '2')""")
    assert df.select(flow_key("d", "t", "m").alias("k")).distinct().count() == 2


def test_flow_duration(spark):
    df = spark.range(1).select(flow_duration(F.lit(3), F.lit(123_456_789)).alias("x"))
    assert df.first()["x"] == 3.1235


def log(spark, rows):
    return spark.createDataFrame(rows, SCENARIO_LOG)


@pytest.mark.parametrize("options", [{}, {"small_log": 0}, {"small_log": 0, "rows_per_chunk": 1}])
def test_label_by_scenario(spark, options):
    changes = log(spark, [
        ("ddos", at(10), 1), (" scanning \n", at(20), 2), ("spoofing", at(20), 3),
        ("normal", at(500), 4)])
    times = [0, 9.999999, 10, 19, 20, 499, 500, 10_000]
    df = spark.createDataFrame([(i, at(t)) for i, t in enumerate(times)], "i int, event_ts timestamp")
    got = [r["label"] for r in label_by_scenario(df, changes, **options).orderBy("i").collect()]
    assert got == ["normal", "normal", "ddos", "ddos", "spoofing", "spoofing", "normal", "normal"]


@pytest.mark.parametrize("options", [{}, {"small_log": 0}])
def test_label_with_bursts_and_random_times(spark, options):
    rng = random.Random(3)
    changes = [(rng.choice("abc"), at(rng.choice([100, 101, rng.uniform(0, 5000)])), i) for i in range(60)]
    times = [rng.uniform(-100, 6000) for _ in range(300)] + [100, 101, 100]
    df = spark.createDataFrame([(i, at(t)) for i, t in enumerate(times)], "i int, event_ts timestamp")
    got = {r["i"]: r["label"] for r in label_by_scenario(df, log(spark, changes), **options).collect()}
    assert len(got) == len(times)
    for i, t in enumerate(times):
        before = [c for c in changes if c[1] <= at(t)]
        want = max(before, key=lambda c: (c[1], c[2]))[0] if before else "normal"
        assert got[i] == want


def test_empty_log_means_normal(spark):
    df = spark.createDataFrame([(at(1),)], "event_ts timestamp")
    assert label_by_scenario(df, log(spark, [])).first()["label"] == "normal"


@pytest.mark.parametrize("options", [{}, {"small_log": 0}])
def test_within_recording(spark, options):
    windows = spark.createDataFrame(
        [(1, at(10), at(20)), (2, at(30), None)], RECORDING_WINDOWS)
    df = spark.createDataFrame(
        [(t, at(t)) for t in (0, 10, 19, 20, 29, 30, 99)], "t int, event_ts timestamp")
    got = within_recording(df, windows, **options).orderBy("t").collect()
    assert [(r["t"], r["session_id"]) for r in got] == [(10, 1), (19, 1), (30, 2), (99, 2)]


def test_first_sample_of_each_session_is_left_out(spark):
    stats = [
        (at(t), 1, 0, {"in_port": "1"}, p, p * 100, t, 500_000_000, 1, 0, 0, 0)
        for t, p in ((0, 5), (10, 10), (11, 20), (30, 40), (31, 60))]
    windows = spark.createDataFrame([(1, at(10), at(20)), (2, at(30), at(40))], RECORDING_WINDOWS)
    changes = log(spark, [("ddos", at(25), 1)])
    rows = capture(spark.createDataFrame(stats, FLOW_STATS), changes, windows).orderBy("event_ts").collect()
    assert [(r["pkts_per_s"], r["label"], r["flow_duration"]) for r in rows] == [
        (10.0, "normal", 11.5), (20.0, "ddos", 31.5)]


def test_features_are_in_file_order(spark):
    stats = spark.createDataFrame(
        [(at(t), 1, 0, {"a": "b"}, t + 1, 10, t, 0, 1, 2, 3, 4) for t in (0, 1)], FLOW_STATS)
    windows = spark.createDataFrame([(1, at(0), None)], RECORDING_WINDOWS)
    rows = capture(stats, log(spark, []), windows)
    assert rows.columns[3:] == list(CSV_HEADERS)
    assert flow_features(rows.withColumns({
        "duration_sec": F.lit(1), "duration_nsec": F.lit(0)})).columns == list(CSV_HEADERS)


@pytest.mark.parametrize("kind", ["decimal(4,1)", "string", "long"])
def test_any_tiebreak_gives_the_same_in_chunks(spark, kind):
    rows = [("f", at(0), 1, 10, "1.2"), ("f", at(0), 2, 20, "1.4"), ("f", at(0), 3, 30, None),
            ("f", at(7200), 9, 90, "3")]
    df = spark.createDataFrame(
        rows, "flow_key string, event_ts timestamp, packet_count long, byte_count long, tie string")
    if kind == "long":
        df = df.filter("tie IS NULL OR tie = '3'")
    df = df.withColumn("tie", F.col("tie").cast(kind))
    got = [
        sorted(counter_deltas(df, "flow_key", tiebreak="tie", rows_per_chunk=n)
               .select("packet_count", "prev_packet_count").collect())
        for n in (1, 1_000_000)]
    assert got[0] == got[1] and got[0]


def test_string_sessions_in_a_long_log(spark):
    windows = spark.createDataFrame(
        [(f"s{i}", at(10 * i), at(10 * i + 5)) for i in range(5)],
        "session_id string, start_ts timestamp, end_ts timestamp")
    rows = spark.createDataFrame([(i, at(i)) for i in range(50)], "id long, event_ts timestamp")
    few, many = (
        sorted(within_recording(rows, windows, small_log=n).select("id", "session_id").collect()) for n in (1_000, 0))
    assert few == many and len(few) == 25


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_a_long_log_meets_crowded_moments_and_rows_without_a_time(spark, size):
    rng = random.Random(5)
    changes = [(rng.choice("abc"), at(rng.choice([100, 100, rng.uniform(0, 5000)])), i) for i in range(80)]
    times = [rng.uniform(-100, 6000) for _ in range(100)] + [100] * 300 + [4000] * 100
    rows = [(i, at(t)) for i, t in enumerate(times)] + [(-1, None)]
    df = spark.createDataFrame(rows, "i int, event_ts timestamp")
    got = label_by_scenario(df, log(spark, changes), small_log=0, rows_per_chunk=size).collect()
    assert sorted(r["i"] for r in got) == sorted(i for i, _ in rows)
    for r in got:
        before = [c for c in changes if r["event_ts"] is not None and c[1] <= at(times[r["i"]])]
        want = max(before, key=lambda c: (c[1], c[2]))[0] if before else "normal"
        assert r["label"] == want
