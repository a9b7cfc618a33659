"""Flow counters to per-interval rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.functions import flow_duration, round_np
from flowscope.operators.ordered import ROWS_PER_CHUNK, with_previous
from flowscope.schemas import RAW_FLOWS

COUNTERS = ["packet_count", "byte_count"]


def add_deltas(df: DataFrame, ts: str, counters: list[str]) -> DataFrame:
    """Seconds and counter steps since the previous sample; rows without one are left out."""
    prev = f"prev_{ts}"
    seconds = (F.unix_micros(ts) - F.unix_micros(prev)) / F.lit(1e6)
    steps = {f"delta_{c}": F.col(c) - F.col(f"prev_{c}") for c in counters}
    return df.filter(F.col(prev).isNotNull()).withColumns({"dt": seconds, **steps})


def counter_deltas(
    df: DataFrame,
    key: str | list[str],
    ts: str = "event_ts",
    counters: list[str] = COUNTERS,
    tiebreak: str | None = None,
    session: str | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Difference each sample with the one before it in the same key (and session)."""
    keys = [key] if isinstance(key, str) else list(key)
    if session is not None:
        keys.append(session)
    sampled = with_previous(df, keys, ts, [ts, *counters], tiebreak, rows_per_chunk)
    return add_deltas(sampled, ts, counters)


def min_gap(df: DataFrame, seconds: float = 0.1) -> DataFrame:
    return df.filter(F.col("dt") > F.lit(float(seconds)))


def active_only(df: DataFrame) -> DataFrame:
    return df.filter((F.col("delta_packet_count") > 0) | (F.col("packet_count") > 0))


def flow_rates(df: DataFrame, digits: int = 4) -> DataFrame:
    """Packet rate, byte rate and mean packet length; a counter that fell back gives 0.

    The two counters are tested one by one. ``dt`` must be positive (see ``min_gap``).
    """
    dp, db, dt = F.col("delta_packet_count"), F.col("delta_byte_count"), F.col("dt")
    zero = F.lit(0.0)
    return df.withColumns({
        "pkts_per_s": round_np(F.when(dp >= 0, dp / dt).otherwise(zero), digits),
        "byts_per_s": round_np(F.when(db >= 0, db / dt).otherwise(zero), digits),
        "pkt_len_mean": round_np(
            F.when(db >= 0, db / F.greatest(dp, F.lit(1))).otherwise(zero), digits
        ),
    })


def flow_features(df: DataFrame, identity: list[str] | None = None) -> DataFrame:
    """The eleven features and the label in file order, after any ``identity`` columns."""
    timed = df.withColumn("flow_duration", flow_duration("duration_sec", "duration_nsec"))
    return timed.select(*(identity or []), *RAW_FLOWS.fieldNames())
