"""Sketches of ports and times: merged over bins and runs, against the exact operators."""

import random

import pytest
from pyspark.sql import functions as F

from flowscope.operators import sketches as sk


def test_ports_of_merged_bins(spark):
    """Few ports are exact; 40,000 are within three standard errors; null ports do not count."""
    rng = random.Random(1)
    rows = [("s", float(b), p) for b in range(8) for p in [*rng.sample(range(60_000), 5_000 * (b >= 4) + 20), None]]
    df = spark.createDataFrame(rows, "scenario string, time_bin double, dst_port int")
    exact = {}
    for _, b, p in rows:
        exact.setdefault(b // 4 * 4, set()).add(p)
    merged = sk.merge_port_sketches(sk.port_sketches(df), 4)
    got = {r["time_bin"]: r["ports_per_sec"] * 4 for r in sk.sketched_port_rate(merged, 4).collect()}
    want = {b: len(p - {None}) for b, p in exact.items()}
    assert got[0.0] == want[0.0]
    assert abs(got[4.0] / want[4.0] - 1) < 3 * 1.04 / 2 ** (sk.PORT_BITS / 2)
    none = sk.port_sketches(df.limit(0))
    assert sk.sketched_port_rate(sk.merge_port_sketches(none, 4), 4).collect() == []


@pytest.mark.parametrize("spread", ["uniform", "crowded"])
def test_quantiles_of_merged_runs(spark, spread):
    rng = random.Random(2)
    draw = (lambda: rng.uniform(0, 9)) if spread == "uniform" else (lambda: float(rng.choice([1, 1, 1, 2, 50])))
    values = [draw() for _ in range(30_000)]
    rows = [("a", i % 7, v) for i, v in enumerate(values)] + [("b", 1, None), ("b", 2, float("nan")), (None, 1, 3.0)]
    df = spark.createDataFrame(rows, "scenario string, run int, inference_time_ms double")
    kept = sk.time_sketches(df, ["scenario", "run"])
    got = {r["scenario"]: r for r in sk.sketched_inference_stats(sk.merge_time_sketches(kept)).collect()}
    assert set(got) == {"a", "b"}
    assert (got["b"]["n"], got["b"]["mean"], got["b"]["median"], got["b"]["p95"]) == (0, None, None, None)
    a = got["a"]
    assert a["n"] == len(values) and a["max"] == max(values) and abs(a["mean"] - sum(values) / len(values)) < 1e-9
    for name, p in (("median", 0.5), ("p95", 0.95)):
        below, upto = (sum(f(v) for v in values) / len(values) for f in (lambda v: v < a[name], lambda v: v <= a[name]))
        assert below - sk.RANK_ERROR <= p <= upto + sk.RANK_ERROR
    assert df.filter("scenario = 'a'").select(F.countDistinct("run")).first()[0] == 7
