import random

import numpy as np
import pytest

from flowscope.functions import relative_bin, round_np
from flowscope.operators.telemetry import (
    action_counts,
    drop_markers,
    exact_percentiles,
    global_t0,
    inference_stats,
    positive_or_all,
    scenario_t0,
    unique_port_rate,
)
from flowscope.plans import reports as rp
from flowscope.schemas import METRICS, TIMING

EMPTY = {f.name: None for f in METRICS}


def metrics(spark, rows):
    return spark.createDataFrame(
        [tuple({**EMPTY, **r}[f.name] for f in METRICS) for r in rows], METRICS)


def timing(spark, rows):
    return spark.createDataFrame(rows, TIMING)


def test_round_np_is_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (-0.125,), (1.005,)], "x double")
    got = [r[0] for r in df.select(round_np("x", 2)).collect()]
    assert got == [float(v) for v in np.round([0.125, 0.375, -0.125, 1.005], 2)]


def test_bins_floor_below_zero(spark):
    df = spark.createDataFrame([(-0.5,), (0.0,), (1.99,), (2.0,)], "x double")
    assert [r[0] for r in df.select(relative_bin("x")).collect()] == [-2.0, 0.0, 0.0, 2.0]


SCAN = [(-0.5, 80, "DROP"), (0.0, 80, "DROP"), (0.5, 80, "ALLOW"), (1.99, 443, "ALLOW"),
        (1.0, None, "ALLOW"), (2.0, None, "DROP")]


def scan(spark):
    rows = [{"timestamp": 100 + t, "dst_port": p, "action_taken": a, "scenario": "scanning"}
            for t, p, a in SCAN]
    return metrics(spark, rows), timing(spark, [("scanning", 100.0, None)])


def test_scan_activity(spark):
    m, t = scan(spark)
    got = {r["time_bin"]: (r["ports_per_sec"], r["drops"]) for r in rp.scan_activity(m, t).collect()}
    assert got == {-2.0: (0.5, 1), 0.0: (1.0, 1), 2.0: (0.0, 1)}
    rates = {r["time_bin"]: r["ports_per_sec"]
             for r in unique_port_rate(rp.scan_bins(m, t)).collect()}
    assert rates == {-2.0: 0.5, 0.0: 1.0, 2.0: 0.0}


def test_drop_markers(spark):
    m, t = scan(spark)
    got = sorted(tuple(r) for r in rp.scan_drop_markers(m, t).collect())
    assert got == [(-0.5, 0.5), (0.0, 1.0), (2.0, 0.0)]
    drops = spark.createDataFrame([(4.0,)], "time_bin double")
    bins = spark.createDataFrame([(0.0, 9.0)], "time_bin double, ports_per_sec double")
    assert drop_markers(drops, bins).first()["ports_per_sec"] == 0.0


def test_scenario_and_global_start(spark):
    m = metrics(spark, [{"timestamp": 7.0, "scenario": "ddos"}, {"timestamp": 5.0, "scenario": "ddos"},
                        {"timestamp": 6.0, "scenario": "normal"}])
    starts = lambda t: {r["scenario"]: r["t0"] for r in scenario_t0(m, t).collect()}
    none = timing(spark, [])
    assert starts(none) == {"ddos": 5.0, "normal": 6.0}
    some = timing(spark, [("ddos", 3.0, None), ("ddos", 9.0, None), ("scanning", 1.0, None)])
    assert starts(some) == {"ddos": 3.0, "normal": 6.0}
    assert global_t0(m, none).first()["t0"] == 5.0
    assert global_t0(m, some).first()["t0"] == 5.0
    assert global_t0(m, timing(spark, [("ddos", 3.0, 2.5), ("normal", 3.0, 2.0)])).first()["t0"] == 2.0


def test_positive_or_all(spark):
    nan = float("nan")
    rows = lambda values: spark.createDataFrame([(v,) for v in values], "x double")
    kept = lambda values: sorted(r[0] for r in positive_or_all(rows(values), "x").collect())
    assert kept([0.0, 0.0]) == [0.0, 0.0]
    assert kept([0.0, 2.0, nan, 1.0]) == [1.0, 2.0]
    assert positive_or_all(rows([None, 0.0, nan]), "x").count() == 3


def test_infrastructure_impact(spark):
    rows = [{"timestamp": 10.0, "cpu_percent": 1.0, "mitigation_latency_ms": 0.0},
            {"timestamp": 11.0, "cpu_percent": 2.0, "mitigation_latency_ms": 4.0}]
    got = [tuple(r) for r in rp.infrastructure_impact(metrics(spark, rows), timing(spark, []))
           .orderBy("global_time_sec").collect()]
    assert got == [(0.0, 1.0, None), (1.0, 2.0, 4.0)]
    got = [tuple(r) for r in rp.infrastructure_impact(metrics(spark, rows[:1]), timing(spark, [])).collect()]
    assert got == [(0.0, 1.0, 0.0)]


def test_action_counts_leave_null_keys_out(spark):
    keys = {"scenario": "ddos", "predicted_label": "ddos", "action_taken": "DROP"}
    rows = [keys, keys, {**keys, "action_taken": None}, {**keys, "scenario": None}]
    assert [tuple(r) for r in action_counts(metrics(spark, rows)).collect()] == [
        ("ddos", "ddos", "DROP", 2)]


def test_inference_stats_by_hand(spark):
    values = [1.0, 2.0, 3.0, 4.0, 10.0, 7.0, float("nan")]
    rows = [{"scenario": "ddos", "inference_time_ms": v} for v in values]
    rows += [{"scenario": "normal", "inference_time_ms": float("nan")}]
    got = {r["scenario"]: tuple(r)[1:] for r in inference_stats(metrics(spark, rows)).collect()}
    assert got == {"ddos": (4.5, 3.5, 10.0, 9.25), "normal": (None, None, None, None)}
    approx = inference_stats(metrics(spark, rows), exact=False)
    assert approx.columns == ["scenario", "mean", "median", "max", "p95"]


@pytest.mark.parametrize("draw", ["spread", "copies", "signed", "single"])
def test_percentiles_match_numpy(spark, draw):
    rng = random.Random(11)
    make = {
        "spread": lambda: rng.lognormvariate(0, 3),
        # a third of all values are equal
        "copies": lambda: 5.0 if rng.random() < 0.34 else rng.uniform(0, 10),
        "signed": lambda: rng.gauss(0, 1e6),
        "single": lambda: 3.25,
    }[draw]
    data = [(g, make()) for g, n in (("a", 2000), ("b", 7), ("c", 1)) for _ in range(n)]
    df = spark.createDataFrame(data, "g string, x double")
    probs = {"low": 0.0, "median": 0.5, "p95": 0.95, "high": 1.0}
    for r in (r for few in (0, 10**9) for r in exact_percentiles(df, "g", "x", probs, few).collect()):
        values = [x for g, x in data if g == r["g"]]
        assert r["n"] == len(values)
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_timelines_and_empty_input(spark):
    rows = [{"timestamp": 5.0, "pkt_rate": 1.5, "action_taken": "DROP", "scenario": "ddos"},
            {"timestamp": 6.0, "pkt_rate": 2.5, "action_taken": None, "scenario": "ddos"}]
    got = rp.attack_timeline(metrics(spark, rows), timing(spark, []), "ddos").orderBy("scenario_time_sec")
    assert [tuple(r) for r in got.collect()] == [(0.0, 1.5, True), (1.0, 2.5, False)]
    none = metrics(spark, [])
    for table in rp.report(none, timing(spark, [])).values():
        assert table.count() == 0
    assert rp.run_summary(none).count() == 0


def test_report_choice(spark):
    m, t = scan(spark)
    assert list(rp.report(m, t, "scanning")) == ["scanning"]
    assert set(rp.report(m, t)) == {"ddos", "spoofing", "scanning", "infrastructure", "inference"}
    with pytest.raises(ValueError):
        rp.report(m, t, "normal")


@pytest.mark.parametrize("low, high", [(0.0, 2e-4), (5.0, 5.0005), (-1e-6, 1e-6), (3.0, 3.0)])
def test_percentiles_of_crowded_values(spark, low, high):
    rng = random.Random(9)
    values = [rng.uniform(low, high) for _ in range(2_000)] + [low, high, high, float("inf")]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    want = np.percentile(values, [1, 50, 95])
    for few in (0, 10**9):
        got = exact_percentiles(df, "g", "v", {"p1": 0.01, "median": 0.5, "p95": 0.95}, few).first()
        assert np.allclose([got["p1"], got["median"], got["p95"]], want, rtol=1e-12, atol=0)
