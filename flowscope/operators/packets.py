"""Packet-in events: learned ports, forwarding decisions, device liveness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.functions import order_key
from flowscope.operators.ordered import ROWS_PER_CHUNK, with_latest
from flowscope.schemas import DEVICE_LIVE, ETHERTYPE_LLDP, FLOOD


def drop_lldp(packets: DataFrame) -> DataFrame:
    return packets.filter(~F.col("ethertype").eqNullSafe(F.lit(ETHERTYPE_LLDP)))


def last_known_port(packets: DataFrame) -> DataFrame:
    """Newest port each source address was seen on, per device (batch or stream)."""
    newest = order_key("event_ts", "seq")
    return (
        drop_lldp(packets)
        .groupBy("dpid", "eth_src")
        .agg(F.max_by("in_port", newest).alias("port"))
    )


def forwarding_decisions(packets: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add ``out_port``: the port learned for the destination so far, else ``FLOOD``.

    Each packet teaches its own source before it asks for its destination; one scan turns
    it into both rows, and the teaching row stays narrow.
    """
    frames = drop_lldp(packets)
    packet = F.struct(*frames.columns)
    lesson = F.struct(
        F.lit(0).alias("kind"),
        F.col("eth_src").alias("mac"),
        F.col("in_port").alias("port"),
        F.when(F.lit(False), packet).alias("packet"),
    )
    question = F.struct(
        F.lit(1).alias("kind"),
        F.col("eth_dst").alias("mac"),
        F.lit(None).cast(frames.schema["in_port"].dataType).alias("port"),
        packet.alias("packet"),
    )
    rows = frames.select("dpid", "event_ts", "seq", F.inline(F.array(lesson, question)))
    known = with_latest(
        rows, ["dpid", "mac"], "event_ts", ["event_ts", "seq", "kind"], "port",
        order_key("event_ts", "seq"), "learned", rows_per_chunk,
    )
    out_port = F.coalesce(F.col("learned").cast("string"), F.lit(FLOOD))
    return known.filter(F.col("kind") == 1).select("packet.*", out_port.alias("out_port"))


def rule_worthy(decisions: DataFrame) -> DataFrame:
    """The forwarding rules that the decisions call for, each once."""
    return (
        decisions.filter(F.col("out_port") != F.lit(FLOOD))
        .select("dpid", "in_port", "eth_dst", "out_port", F.lit(1).alias("priority"))
        .distinct()
    )


def live_devices(states: DataFrame, tiebreak: str | None = None) -> DataFrame:
    """Devices whose newest state is live (batch or stream)."""
    live = F.col("state") == F.lit(DEVICE_LIVE)
    newest = F.max_by(live, order_key("event_ts", tiebreak))
    return states.groupBy("dpid").agg(newest.alias("live")).filter("live").select("dpid")
