"""Keys with more rows than a chunk: cut by time and tiebreak, equal to the plain window."""

import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from flowscope.operators.counters import counter_deltas
from flowscope.operators.ordered import hot_keys, order_cuts, placed, with_previous
from flowscope.operators.packets import forwarding_decisions
from flowscope.schemas import PACKET_IN


def plain_previous(rows, keys):
    last, found = {}, []
    for r in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2])):
        key = tuple(r[0] for _ in keys)
        found.append((r[2], r[3], last.get(key)))
        last[key] = r[3]
    return sorted(map(str, found))


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("times", [1, 2, 500])
def test_one_key_whose_rows_share_an_instant(spark, kind, times):
    """All rows at one instant, at two, or spread; whole-number and text tiebreaks, a null one."""
    rng = random.Random(times)
    ties = rng.sample(range(10_000), 500)
    rows = [("hot" if i % 5 else None, at(rng.randrange(times)), t if kind == "long" else f"t{t}", i)
            for i, t in enumerate(ties)]
    rows += [("cold", at(i), t, i) for i, t in enumerate([7, 8, 9] if kind == "long" else ["a", "b", "c"])]
    rows.append(("hot", at(0), None, 999))
    df = spark.createDataFrame(rows, f"key string, ts timestamp, tie {kind}, v long")
    for n in (10**9, 40, 7):
        got = with_previous(df, ["key"], "ts", ["v"], "tie", n)
        assert got.columns == ["key", "ts", "tie", "v", "prev_v"]
        assert sorted(map(str, (tuple(r) for r in got.select("tie", "v", "prev_v").collect()))) == plain_previous(rows, ["key"])


def test_an_instant_is_cut_into_parts_of_about_a_chunk(spark):
    df = spark.range(4_000).select(F.lit(at(0)).alias("ts"), F.col("id").alias("tie"))
    cuts = order_cuts(df, "ts", "tie", 4_000, 500)
    assert len(cuts) == 7
    sizes = [r["count"] for r in placed(df, "ts", "tie", cuts).groupBy("_chunk").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1_500 and sum(sizes) == 4_000
    # without a tiebreak nothing orders them
    assert len(order_cuts(df, "ts", None, 4_000, 500)) <= 1


def test_chunks_rise_with_time_and_tiebreak(spark):
    rng = random.Random(1)
    rows = [(at(rng.choice([0, 0, 0, 1, 2, 2, 9])), rng.randrange(100)) for _ in range(800)]
    df = spark.createDataFrame(rows, "ts timestamp, tie long")
    cuts = order_cuts(df, "ts", "tie", 800, 30)
    got = sorted(placed(df, "ts", "tie", cuts).collect(), key=lambda r: (r["ts"], r["tie"]))
    chunks = [r["_chunk"] for r in got]
    assert chunks == sorted(chunks) and len(set(chunks)) > 15


def test_what_comes_to_the_driver_does_not_grow_with_the_rows(spark, monkeypatch):
    """Borders and hot keys are as many as the limits say, whatever the rows, and cut as right."""
    from flowscope import sizing
    from flowscope.operators import ordered

    monkeypatch.setattr(ordered, "MOST_CHUNKS", 16)
    timed = spark.range(20_000).select(F.timestamp_seconds(F.col("id") % 977).alias("ts"), F.col("id").alias("tie"))
    cuts = order_cuts(timed, "ts", "tie", 20_000, 5)
    assert 8 < len(cuts) < 16
    df = timed.withColumn("key", (F.col("tie") % 50).cast("string")).withColumn("v", F.col("tie"))
    # more hot keys than go to the driver are never there as a local relation
    monkeypatch.setattr(ordered, "small_or_same", lambda found: sizing.small_or_same(found, 10))
    hot = hot_keys(df, ["key"], 5)
    assert hot.count() == 50 and "LocalTableScan" not in hot._jdf.queryExecution().executedPlan().toString()
    want = with_previous(df, ["key"], "ts", ["v"], "tie", 10**9)
    got = with_previous(df, ["key"], "ts", ["v"], "tie", 5).select(*want.columns)
    assert got.count() == 20_000 and got.exceptAll(want).isEmpty()


def test_the_plan_is_unchanged_without_hot_keys(spark):
    df = spark.range(1_000).selectExpr(
        "CAST(id % 50 AS STRING) AS flow_key", "timestamp_seconds(id) AS event_ts", "id AS packet_count",
        "id AS byte_count", "id AS seq")
    assert hot_keys(df, ["flow_key"], 20) is None
    assert {r["_n"] for r in hot_keys(df, ["flow_key"], 19).collect()} == {20}

    def plan(n):
        deltas = counter_deltas(df, "flow_key", tiebreak="seq", rows_per_chunk=n)
        return deltas._jdf.queryExecution().executedPlan().toString()

    assert plan(20).count("Window") == plan(10**9).count("Window") and "Join" not in plan(20)
    # only hot keys are cut: the others keep one chunk
    skewed = df.withColumn("flow_key", F.when(F.col("seq") < 700, "hot").otherwise(F.col("flow_key")))
    for n in (100, 10**9):
        got = counter_deltas(skewed, "flow_key", tiebreak="seq", rows_per_chunk=n)
        assert got.filter("flow_key = 'hot'").agg(F.count("*"), F.sum("delta_packet_count")).first()[:] == (699, 699)
        assert got.count() == 1_000 - 51


@pytest.mark.parametrize("rows_per_chunk", [20, 10**9])
def test_decisions_at_one_instant(spark, rows_per_chunk):
    """Everything happens at once and asks for one address; ``seq`` alone gives the order."""
    rng = random.Random(9)
    rows = [(at(0), i, 1, rng.randrange(9), "victim" if rng.random() < 0.05 else f"h{rng.randrange(20)}",
             "victim" if i % 2 else f"h{rng.randrange(20)}", 0x0800) for i in range(400)]
    table, want = {}, []
    for _, _, dpid, port, src, dst, _ in rows:
        table[dpid, src] = port
        want.append(str(table.get((dpid, dst), "FLOOD")))
    got = forwarding_decisions(spark.createDataFrame(rows, PACKET_IN), rows_per_chunk).orderBy("seq").collect()
    assert [r["out_port"] for r in got] == want
