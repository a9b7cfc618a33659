"""Counter differencing on a stream that a control stream of recording turns on and off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.operators.counters import COUNTERS, add_deltas
from flowscope.streaming.recorded_state import MISSING, POLL, SWITCH, RecordedSamples

#: groups that flows are dealt to, each with its copy of the switch
BUCKETS = 64


def switch_events(windows: DataFrame) -> DataFrame:
    """Recording windows as the events (``event_ts``, ``on``) of their control stream."""
    events = F.array(
        F.struct(F.col("start_ts").alias("event_ts"), F.lit(True).alias("on")),
        F.struct(F.col("end_ts").alias("event_ts"), F.lit(False).alias("on")))
    return windows.select(F.inline(events)).filter(F.col("event_ts").isNotNull())


def stream_recorded_deltas(
    polls: DataFrame, control: DataFrame, key: str = "flow_key", ts: str = "event_ts",
    counters: list[str] = COUNTERS, tiebreak: str | None = None, late: str = "10 seconds", buckets: int = BUCKETS,
) -> DataFrame:
    """Streaming form of ``counter_deltas`` with sessions, by the turns of a control stream.

    ``control`` has ``event_ts`` and ``on``. Polls count while recording is on, and every turn
    forgets the samples of all flows, so the first poll of a flow after it has none before it,
    also where recording went off and on between two polls. An event that changes nothing only
    moves the watermark. Polls and events are put in order of time behind one watermark; at
    one instant the switch comes first, an off before an on. What comes more than ``late``
    behind is dropped and counted as such.

    Flows are dealt to ``buckets`` groups, and each event goes to all of them. Returns ``key``,
    ``ts``, the tiebreak, the counters and what ``counter_deltas`` adds. Counters and tiebreak
    are whole numbers, the key is text. Needs the RocksDB state store.
    """
    missing = F.lit(MISSING)

    def whole(c: str):
        return F.coalesce(F.col(c).cast("long"), missing)

    seq = missing if tiebreak is None else whole(tiebreak)
    flow = F.coalesce(F.concat(F.lit("="), F.col(key)), F.lit(""))
    samples = polls.select(
        F.col(ts).alias("event_ts"), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"),
        F.lit(POLL).alias("kind"), F.lit(0).alias("on"), seq.alias("seq"), flow.alias("flow"),
        *[whole(c).alias(c) for c in counters])
    turns = control.select(
        "event_ts", F.explode(F.array(*[F.lit(i) for i in range(buckets)])).alias("bucket"),
        F.lit(SWITCH).alias("kind"), F.col("on").cast("int").alias("on"), F.col("on").cast("long").alias("seq"),
        F.lit("").alias("flow"), *[missing.alias(c) for c in counters])
    rows = samples.unionByName(turns).withColumn("us", F.unix_micros("event_ts"))
    sample = T.StructType([T.StructField(c, T.LongType()) for c in ("us", *counters)])
    waiting = T.StructType.fromDDL(
        "kind int, on int, us long, seq long, flow string, " + ", ".join(f"`{c}` long" for c in counters))
    out = T.StructType.fromDDL(
        "flow string, us long, seq long, " + ", ".join(f"`{p}{c}` long" for p in ("", "prev_") for c in counters)
        + ", prev_us long")
    found = (
        rows.withWatermark("event_ts", late).groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=RecordedSamples(waiting, sample, out.fieldNames()), outputStructType=out,
            outputMode="Append", timeMode="EventTime"))
    kinds = {f.name: f.dataType for f in polls.schema}

    def back(c: str, name: str):
        return F.nullif(F.col(c), missing).cast(kinds[name]).alias(c if c.startswith("prev_") else name)

    columns = [F.when(F.col("flow") != "", F.substr("flow", F.lit(2))).alias(key)]
    columns += [F.timestamp_micros("us").alias(ts), F.timestamp_micros(F.nullif("prev_us", missing)).alias(f"prev_{ts}")]
    columns += [] if tiebreak is None else [back("seq", tiebreak)]
    columns += [back(f"{p}{c}", c) for p in ("", "prev_") for c in counters]
    return add_deltas(found.select(*columns), ts, counters)
