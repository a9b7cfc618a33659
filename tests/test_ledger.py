"""Tables behind a ledger: whole changes only, retries, crashes, compaction."""

import random

import pytest
from pyspark.sql import functions as F

from flowscope.schemas import METRICS
from flowscope.sources.ledger import ConflictError, KeptTable, Ledger, RowLog, State
from flowscope.streaming.scoring import telemetry_log


def folders(path):
    return sorted(p.name for p in path.iterdir() if not p.name.startswith("_"))


def test_versions_follow_one_another(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "t"))
    assert ledger.current() == State()
    first = ledger.commit(State(-1, 4, ("a",), {"k": "v"}))
    assert ledger.current() == first == State(0, 4, ("a",), {"k": "v"})
    second = ledger.commit(State(0, 5, ("a", "b"), {}))
    assert ledger.current() == second
    with pytest.raises(ConflictError):
        ledger.commit(State(0, 5, ("other",), {}))
    assert ledger.current() == second
    assert not [p for p in (tmp_path / "t/_ledger").iterdir() if p.name.startswith(".draft")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


@pytest.mark.parametrize("buckets", [1, 5])
def test_upsert_keeps_one_row_per_key(spark, tmp_path, buckets):
    """Random batches with a null key, batches run again, and an empty one."""
    rng = random.Random(buckets)
    table = KeptTable(spark, str(tmp_path / "t"), "k long, v string", ["k"], buckets)
    assert table.read().collect() == []
    want = {}
    for i in range(6):
        keys = [] if i == 3 else rng.sample([None, *range(30)], 10)
        rows = [(k, f"{i}-{k}") for k in keys]
        assert table.upsert(frame(spark, rows), i)
        want.update(rows)
        assert {r["k"]: r["v"] for r in table.read().collect()} == want
        # the same batch with other rows changes nothing
        assert not table.upsert(frame(spark, [(1, "again")]), i)
        assert {r["k"]: r["v"] for r in table.read().collect()} == want
    assert table.read().count() == len(want)


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = KeptTable(spark, str(tmp_path / "t"), "k long, v string", ["k"], bucket=F.floor(F.col("k") / 10))
    table.upsert(frame(spark, [(i, "a") for i in range(40)]), 0)
    before = set(table.ledger.current().folders)
    table.upsert(frame(spark, [(15, "b")]), 1)
    after = set(table.ledger.current().folders)
    assert len(before) == len(after) == 4 and len(before & after) == 3
    assert {r["k"] for r in table.read().filter("v = 'a'").collect()} == set(range(40)) - {15}


def test_merge_and_a_reader_of_the_old_version(spark, tmp_path):
    table = KeptTable(spark, str(tmp_path / "t"), "k long, n long", ["k"], 2)
    add = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    one = lambda *rows: spark.createDataFrame(rows, "k long, n long")
    table.upsert(one((1, 5), (2, 6)), 0, add)
    old = table.read()
    table.upsert(one((2, 10), (3, 1)), 1, add)
    assert {tuple(r) for r in old.collect()} == {(1, 5), (2, 6)}  # its files are still there
    assert {tuple(r) for r in table.read().collect()} == {(1, 5), (2, 16), (3, 1)}


def test_a_crash_before_the_ledger_leaves_nothing(spark, tmp_path, monkeypatch):
    table = KeptTable(spark, str(tmp_path / "t"), "k long, v string", ["k"], 1)
    table.upsert(frame(spark, [(1, "a")]), 0)
    commit = Ledger.commit
    monkeypatch.setattr(Ledger, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.upsert(frame(spark, [(1, "b")]), 1)
    monkeypatch.setattr(Ledger, "commit", commit)
    assert [tuple(r) for r in table.read().collect()] == [(1, "a")]
    assert table.upsert(frame(spark, [(1, "c")]), 1)
    assert [tuple(r) for r in table.read().collect()] == [(1, "c")]
    table.ledger.vacuum(keep=1)
    assert len(folders(tmp_path / "t")) == 1  # what the crash left is gone too
    assert [tuple(r) for r in table.read().collect()] == [(1, "c")]


def telemetry(spark, first, n):
    empty = {f.name: None for f in METRICS}
    rows = [{**empty, "timestamp": float(i), "dst_port": i, "scenario": ["ddos", "normal"][i % 2]} for i in range(first, first + n)]
    return spark.createDataFrame([tuple(r[f.name] for f in METRICS) for r in rows], METRICS)


def ports(log):
    return sorted(r["dst_port"] for r in log.read().select("dst_port").collect())


def test_log_of_batches(spark, tmp_path):
    """Retries, a compaction, batches after it, one scenario read by its folders only."""
    log = telemetry_log(spark, str(tmp_path / "t"))
    assert log.read().collect() == [] and log.compact() == 0
    for i in range(5):
        assert log.append(telemetry(spark, 10 * i, 10), i)
        assert not log.append(telemetry(spark, 10 * i, 10), i)
        assert ports(log) == [*range(10 * i + 10)]
    assert log.compact(rows_per_file=10) == 5
    assert len(log.ledger.current().folders) == 1 and ports(log) == [*range(50)]
    assert not log.append(telemetry(spark, 0, 10), 4)  # a compaction does not forget its batches
    assert log.append(telemetry(spark, 50, 4), 5)
    assert ports(log) == [*range(54)] and log.compact() == 0
    log.ledger.vacuum(keep=1)
    assert len(folders(tmp_path / "t")) == 2 and ports(log) == [*range(54)]
    one = log.read().filter("scenario = 'ddos'")
    assert sorted(r["dst_port"] for r in one.collect()) == [*range(0, 54, 2)]
    assert "PartitionFilters: [isnotnull(scenario" in one._jdf.queryExecution().executedPlan().toString()


def test_a_crash_in_mid_swap(spark, tmp_path, monkeypatch):
    """The large folder is written and not named: readers see the small ones, once each."""
    log = telemetry_log(spark, str(tmp_path / "t"))
    for i in range(3):
        log.append(telemetry(spark, 10 * i, 10), i)
    commit = Ledger.commit
    monkeypatch.setattr(Ledger, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        log.compact()
    monkeypatch.setattr(Ledger, "commit", commit)
    assert len(folders(tmp_path / "t")) == 4 and ports(log) == [*range(30)]
    assert log.append(telemetry(spark, 30, 10), 3)
    assert log.compact() == 4 and ports(log) == [*range(40)]


def test_a_batch_during_a_compaction(spark, tmp_path, monkeypatch):
    """The batch is committed between the reading and the swap of a compaction; both stay."""
    log, other = (RowLog(spark, str(tmp_path / "t"), METRICS, "scenario") for _ in range(2))
    for i in range(2):
        log.append(telemetry(spark, 10 * i, 10), i)
    spread = RowLog._spread

    def late(self, *args):
        other.append(telemetry(spark, 20, 10), 2)
        return spread(self, *args)

    monkeypatch.setattr(RowLog, "_spread", late)
    assert log.compact() == 2
    assert ports(log) == [*range(30)] and len(log.ledger.current().folders) == 2
    assert log.ledger.current().batch_id == 2
