"""Counter differencing on a stream: the previous sample of a key is kept as state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery

from flowscope.operators.counters import COUNTERS, add_deltas, flow_features
from flowscope.operators.intervals import label_by_scenario, within_recording
from flowscope.plans.capture import rated, with_flow_key
from flowscope.schemas import IDENTITY
from flowscope.streaming.previous_sample import BLOCK, BUCKET, FLOW, MISSING, PreviousSamples, blocks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TTL_SECONDS = 3600
#: groups that keys are dealt to; a micro-batch calls Python once for each of them
BUCKETS = 1024


def _packed(df: DataFrame) -> DataFrame:
    """Times as epoch microseconds, and whole numbers without nulls.

    The stateful processor sees pandas columns, where times lose their zone and a null turns
    whole numbers into floats, which are exact up to 2^53 only. ``MISSING`` stands for null;
    it sorts first, as nulls do in a window.
    """
    missing = F.lit(MISSING)
    longs = {f.name: F.unix_micros(f.name) if _is_time(f) else F.col(f"`{f.name}`").cast("long")
             for f in df.schema if _is_time(f) or _is_whole(f)}
    return df.withColumns({c: F.coalesce(v, missing) for c, v in longs.items()})


def _unpacked(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    def back(f: T.StructField):
        value = F.nullif(F.col(f"`{f.name}`"), F.lit(MISSING))
        return F.timestamp_micros(value) if _is_time(f) else value.cast(f.dataType)

    return df.withColumns({f.name: back(f) for f in fields if _is_time(f) or _is_whole(f)})


def _is_time(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.TimestampType)


def _is_whole(f: T.StructField) -> bool:
    return isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _as_text(column: Column, kind: T.DataType) -> Column:
    """Text that is equal for equal keys."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (column + F.lit(0.0)).cast("string")  # one zero
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    return column.cast("string") if isinstance(kind, T.AtomicType) else F.to_json(F.struct(column))


def _key_text(df: DataFrame, keys: list[str]) -> Column:
    """All of a key as one text; each part bears its length, and null is its own value."""
    texts = [_as_text(F.col(f"`{k}`"), df.schema[k].dataType) for k in keys]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def stream_counter_deltas(
    df: DataFrame,
    key: str | list[str],
    ts: str = "event_ts",
    counters: list[str] = COUNTERS,
    tiebreak: str | None = None,
    session: str | None = None,
    ttl_seconds: int | None = TTL_SECONDS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Streaming form of ``counter_deltas``.

    The session is part of the key, so a new recording starts from no state. Keys are dealt
    to ``buckets`` groups; what one group brings in one micro-batch is sorted together, and
    its state is read and written as a whole. The source's files or bytes per trigger bound
    it. Needs the RocksDB state store. A time to live follows the clock, so Spark never sees
    such a stream as finished: give None to drain what there is and stop.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if session is not None:
        keys.append(session)
    order = [ts] if tiebreak is None else [ts, tiebreak]
    names = list(dict.fromkeys([*order, *counters]))
    packed = _packed(df)
    fields = packed.schema.fields
    carried = T.StructType([T.StructField(c, packed.schema[c].dataType) for c in names])
    out = T.StructType([
        *fields,
        *[T.StructField(f"prev_{f.name}", f.dataType) for f in carried],
    ])
    ttl_ms = None if ttl_seconds is None else ttl_seconds * 1000
    keyed = packed.withColumn(FLOW, _key_text(packed, keys))
    rows = to_arrow_schema(keyed.schema)
    dealt = keyed.withColumn(BUCKET, F.pmod(F.xxhash64(FLOW), F.lit(buckets)).cast("int")).mapInArrow(
        blocks(rows), f"{BUCKET} int, {BLOCK} binary")
    sampled = dealt.groupBy(BUCKET).transformWithStateInPandas(
        statefulProcessor=PreviousSamples(rows, order, carried, out.fieldNames(), ttl_ms),
        outputStructType=out,
        outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )
    before = [T.StructField(f"prev_{c}", df.schema[c].dataType) for c in names]
    extra = [f"prev_{c}" for c in names if c not in (ts, *counters)]
    return add_deltas(_unpacked(sampled, [*df.schema.fields, *before]), ts, counters).drop(*extra)


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink where every micro-batch owns one folder, and overwrites it when it is run again."""
    return lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def stream_capture(
    flow_stats: DataFrame,
    read_log: Callable[[], DataFrame],
    read_windows: Callable[[], DataFrame],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    tiebreak: str | None = None,
    gap: float = 0.1,
    ttl_seconds: int | None = TTL_SECONDS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Streaming form of ``capture``; ``write`` gets the rows of each micro-batch.

    Scenario log and recording windows are read again for every micro-batch, so they may
    grow meanwhile and be of any length. Samples are differenced whether recorded or not; a
    row stays when its sample and the one before lie in one window. Windows are intervals of
    time that do not overlap, so this equals starting each of them from no state.
    """
    deltas = stream_counter_deltas(
        with_flow_key(flow_stats), "flow_key", tiebreak=tiebreak, ttl_seconds=ttl_seconds)

    def capture_batch(batch: DataFrame, batch_id: int) -> None:
        # a long log is looked up in two passes, and the state must be read once
        rows = batch.persist()
        try:
            recorded = within_recording(rows, read_windows(), since="prev_event_ts")
            labelled = label_by_scenario(rated(recorded, gap), read_log())
            write(flow_features(labelled, IDENTITY), batch_id)
        finally:
            rows.unpersist()

    return _run(deltas, capture_batch, checkpoint, trigger)


def label_batches(
    stream: DataFrame,
    read_log: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Label a stream with a log that goes on growing, and append it to ``path``.

    The log is read again for every micro-batch, so it may be of any length.
    """
    write = batch_folder(path)
    return _run(
        stream, lambda batch, i: write(label_by_scenario(batch, read_log()), i), checkpoint, trigger)


def _run(stream: DataFrame, write: Callable, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_port_rate(metrics: DataFrame, width: int = 2, late: str = "1 minute") -> DataFrame:
    """Distinct ports per second over epoch-aligned windows of a stream.

    Rows that come more than ``late`` behind the newest one may be left out.

    Exact distinct counting is refused on streams; a port set is, and it never holds more
    than the 65,536 ports there are.
    """
    stamped = metrics.withColumn("event_ts", F.timestamp_micros(F.rint(F.col("timestamp") * 1e6).cast("long")))
    ports = F.size(F.collect_set("dst_port")) / F.lit(float(width))
    return (
        stamped.withWatermark("event_ts", late)
        .groupBy(F.window("event_ts", f"{width} seconds").alias("bin"))
        .agg(ports.alias("ports_per_sec"))
    )
