"""As-of lookups against a change log: scenario labels and recording sessions."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowscope.operators.ordered import chunked, newest_first, time_cuts
from flowscope.schemas import DEFAULT_SCENARIO
from flowscope.sizing import small_rows

SMALL_LOG = 1_000
#: rows that one task sorts together with their part of a long log
LOOKUP_CHUNK = 4_000_000

# ASCII whitespace.
WHITESPACE = " \t\n\r\x0b\x0c"


def in_force(
    df: DataFrame,
    ts: str,
    log: DataFrame,
    start: str,
    tiebreak: str,
    payload: list[str],
    small_log: int = SMALL_LOG,
    rows_per_chunk: int = LOOKUP_CHUNK,
    required: bool = False,
) -> DataFrame:
    """Add the ``payload`` of the newest ``log`` row at or before ``ts``.

    Rows before the first log row get nulls, or are left out if it is ``required``.

    A log of at most ``small_log`` rows is broadcast. A longer one is sorted together with
    the rows in chunks of time, so neither its length nor a busy moment meets one task.
    """
    log = log.select(start, tiebreak, *payload).filter(F.col(start).isNotNull())
    head = small_rows(log, small_log)
    if head is None:
        if df.isStreaming:
            raise ValueError(
                f"the log has more than {small_log} rows: "
                "call this on each micro-batch in foreachBatch"
            )
        found = _sorted_lookup(df, ts, log, start, tiebreak, payload, rows_per_chunk)
        return (found.filter(F.col("_found").isNotNull()) if required else found).drop("_found")
    if head.num_rows == 0:
        rows = df.filter(F.lit(False)) if required else df
        return rows.withColumns({c: F.lit(None).cast(log.schema[c].dataType) for c in payload})
    local = df.sparkSession.createDataFrame(head, schema=log.schema)
    micros = pc.min_max(pc.cast(head.column(start), "int64")).as_py()
    if required:
        # a plain comparison reaches the file scan, which skips what is older
        df = df.filter(F.col(ts) >= F.timestamp_micros(F.lit(micros["min"])))
    return _broadcast_lookup(
        df, ts, local, start, tiebreak, payload, micros["min"], micros["max"], head.num_rows,
        "inner" if required else "left",
    )


def _broadcast_lookup(df, ts, log, start, tiebreak, payload, first, last, n, how) -> DataFrame:
    """Equi-join on a time bucket, about one bucket per log row, with the range as residual."""
    width = (last - first) // n + 1
    top = (last - first) // width

    def bucket(us: Column) -> Column:
        cell = F.floor((us - F.lit(first)) / F.lit(width))
        return F.least(F.greatest(cell, F.lit(-1)), F.lit(top))

    begin, end = F.col("_begin"), F.col("_end")
    spans = (
        log.withColumn("_begin", F.unix_micros(start))
        .withColumn("_end", F.lead("_begin").over(W.orderBy(start, tiebreak)))
        # of two rows at one instant the last written stays
        .filter(end.isNull() | (end > begin))
        .withColumn("_stop", F.when(end.isNull(), F.lit(top)).otherwise(bucket(end - 1)))
        .withColumn("_bucket", F.explode(F.sequence(bucket(begin), F.col("_stop"))))
        .select("_bucket", "_begin", "_end", *payload)
    )
    rows = df.withColumn("_us", F.unix_micros(ts)).withColumn("_cell", bucket(F.col("_us")))
    match = (
        (F.col("_cell") == F.col("_bucket"))
        & (F.col("_us") >= begin)
        & (end.isNull() | (F.col("_us") < end))
    )
    # at most two rows per log row, and the log was counted
    joined = rows.join(F.broadcast(spans), match, how)
    return joined.drop("_us", "_cell", "_bucket", "_begin", "_end")


def _sorted_lookup(df, ts, log, start, tiebreak, payload, rows_per_chunk) -> DataFrame:
    """Sort rows and log together, chunk by chunk, and keep the last payload seen.

    The payload in force where a chunk begins is carried in as one more row. A moment that
    holds more rows than a chunk is salted, and only its part of the log is copied.
    """
    rows = df.select("*", F.col(ts).alias("_at"), F.lit(1).alias("_kind"))
    marks = log.select(
        F.col(start).alias("_at"), F.col(tiebreak).alias("_tie"), F.lit(0).alias("_kind"),
        F.struct(*payload).alias("_value"))
    times = rows.select("_at").unionByName(marks.select("_at"))
    cuts = time_cuts(times, "_at", rows_per_chunk)
    # one row per chunk, as for the cuts
    sizes = chunked(times, "_at", cuts).groupBy("_chunk").agg(F.count("*").alias("n")).collect()
    salts = df.sparkSession.createDataFrame(
        [(r["_chunk"], -(-r["n"] // rows_per_chunk) if r["n"] > 2 * rows_per_chunk else 1) for r in sizes],
        "_chunk int, _salts long")

    marks = chunked(marks, "_at", cuts)
    # only the log is aggregated here, not the rows
    ends = marks.groupBy("_chunk").agg(F.max_by("_value", newest_first(marks, "_at", "_tie")).alias("_end"))
    earlier = W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = salts.join(ends, "_chunk", "left").select(
        "_chunk", F.lit(0).alias("_kind"), F.last("_end", ignorenulls=True).over(earlier).alias("_value"))

    hashable = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    own = F.pmod(F.xxhash64(*hashable), F.col("_salts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))
    probes = chunked(rows, "_at", cuts).join(F.broadcast(salts), "_chunk").withColumn("_salt", own)
    known = marks.unionByName(carried, allowMissingColumns=True)
    known = known.join(F.broadcast(salts), "_chunk").withColumn("_salt", every)
    # a carried row has no time of its own, and nulls sort first
    seen = W.partitionBy("_chunk", "_salt").orderBy("_at", "_kind", "_tie").rowsBetween(W.unboundedPreceding, 0)
    found = (
        probes.unionByName(known, allowMissingColumns=True)
        .withColumn("_found", F.last("_value", ignorenulls=True).over(seen))
        .filter(F.col("_kind") == 1)
        # a row without a time has nothing before it
        .withColumn("_found", F.when(F.col("_at").isNotNull(), F.col("_found"))))
    hit = {c: F.col("_found")[c] for c in payload}
    return found.withColumns(hit).select(*df.columns, *payload, "_found")


def label_by_scenario(
    df: DataFrame,
    log: DataFrame,
    default: str = DEFAULT_SCENARIO,
    ts: str = "event_ts",
    small_log: int = SMALL_LOG,
    rows_per_chunk: int = LOOKUP_CHUNK,
) -> DataFrame:
    """Add ``label``: the scenario in force at ``ts``, ``default`` before the first change."""
    names = log.select("start_ts", "seq", F.btrim("scenario", F.lit(WHITESPACE)).alias("label"))
    found = in_force(df, ts, names, "start_ts", "seq", ["label"], small_log, rows_per_chunk)
    return found.withColumn("label", F.coalesce("label", F.lit(default)))


def within_recording(
    df: DataFrame,
    windows: DataFrame,
    ts: str = "event_ts",
    small_log: int = SMALL_LOG,
    rows_per_chunk: int = LOOKUP_CHUNK,
    since: str | None = None,
) -> DataFrame:
    """Keep rows inside a recording window and add its ``session_id``.

    Windows do not overlap: the flag is on or off. An open window has a null ``end_ts``.
    With ``since`` that earlier time of a row has to lie in the same window.
    """
    sessions = windows.select(
        "start_ts", "session_id", F.col("session_id").alias("_order"),
        F.col("start_ts").alias("_from"), F.col("end_ts").alias("_until"))
    found = in_force(
        df, ts, sessions, "start_ts", "_order", ["session_id", "_from", "_until"], small_log,
        rows_per_chunk, required=True,
    )
    inside = F.col("_until").isNull() | (F.col(ts) < F.col("_until"))
    if since is not None:
        inside &= F.col(since) >= F.col("_from")
    return found.filter(inside).drop("_from", "_until")
