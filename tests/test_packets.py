import random

import pytest
from conftest import at

from flowscope.operators.packets import (
    forwarding_decisions,
    last_known_port,
    live_devices,
    rule_worthy,
)
from flowscope.schemas import DEVICE_STATE, PACKET_IN


def packets(spark, rows):
    full = [(at(t), seq, d, port, src, dst, eth) for seq, (t, d, port, src, dst, eth) in enumerate(rows)]
    return spark.createDataFrame(full, PACKET_IN)


IP, LLDP = 0x0800, 0x88CC


def test_decisions_by_hand(spark):
    df = packets(spark, [
        (0, 1, 1, "a", "b", IP),   # b is learned later
        (1, 1, 2, "b", "a", IP),   # a is known on port 1
        (2, 1, 3, "c", "c", IP),   # own address
        (3, 2, 4, "d", "a", IP),   # other device
        (4, 1, 9, "a", "x", LLDP),  # teaches nothing
        (5, 1, 2, "b", "a", IP),
        (6, 1, 5, "a", "b", IP),   # a moved
        (7, 1, 2, "b", "a", IP),
    ])
    got = forwarding_decisions(df)
    assert [(r["seq"], r["out_port"]) for r in got.orderBy("seq").collect()] == [
        (0, "FLOOD"), (1, "1"), (2, "3"), (3, "FLOOD"), (5, "1"), (6, "2"), (7, "5")]
    rules = {tuple(r) for r in rule_worthy(got).collect()}
    assert rules == {(1, 2, "a", "1", 1), (1, 3, "c", "3", 1), (1, 5, "b", "2", 1), (1, 2, "a", "5", 1)}
    ports = {(r["dpid"], r["eth_src"]): r["port"] for r in last_known_port(df).collect()}
    assert ports == {(1, "a"): 5, (1, "b"): 2, (1, "c"): 3, (2, "d"): 4}


@pytest.mark.parametrize("rows_per_chunk", [50, 10**9])
def test_decisions_with_a_hot_address(spark, rows_per_chunk):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        dst = "victim" if i % 3 == 0 else f"h{rng.randrange(40)}"
        src = "victim" if rng.random() < 0.01 else f"h{rng.randrange(40)}"
        rows.append((i * 31, rng.randrange(2), rng.randrange(9), src, dst, IP))
    got = forwarding_decisions(packets(spark, rows), rows_per_chunk).orderBy("seq").collect()
    table, want = {}, []
    for _, dpid, port, src, dst, _ in rows:
        table[dpid, src] = port
        want.append(str(table.get((dpid, dst), "FLOOD")))
    assert [r["out_port"] for r in got] == want


def test_live_devices(spark):
    df = spark.createDataFrame([
        (at(0), 1, "MAIN"), (at(1), 1, "DEAD"), (at(0), 2, "DEAD"), (at(2), 2, "MAIN"),
        (at(0), 3, "MAIN")], DEVICE_STATE)
    assert sorted(r["dpid"] for r in live_devices(df).collect()) == [2, 3]
