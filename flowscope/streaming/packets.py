"""Packet operators on streams: forwarding decisions by state, and kept tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowscope.functions import order_key
from flowscope.operators.packets import last_known_port
from flowscope.schemas import DEVICE_LIVE, ETHERTYPE_LLDP, FLOOD
from flowscope.sources.ledger import KeptTable
from flowscope.streaming.learned_ports import LESSON, MISSING, LearnedPorts

QUESTION = LESSON + 1
#: groups that addresses are dealt to
BUCKETS = 64


def stream_forwarding_decisions(
    packets: DataFrame, late: str = "10 seconds", salts: int = 1, buckets: int = BUCKETS,
) -> DataFrame:
    """Streaming form of ``forwarding_decisions``; needs the RocksDB state store.

    A decision comes when the watermark, the newest event time less ``late``, has passed its
    packet; a packet that comes after that teaches and asks nothing and is counted among the
    rows dropped by the watermark. Link-layer discovery frames teach and ask nothing, but
    their times move the watermark.

    The state is one port per device and address, and the packets not yet due. Addresses are
    dealt to ``buckets`` groups, which is the most tasks that decide at a time. With
    ``salts`` the questions about one address are dealt to so many tasks, and each of them
    gets all its lessons: for addresses that are asked for much more often than they send.
    Packets have the columns of the packet-in table.
    """
    us, missing = F.unix_micros("event_ts"), F.lit(MISSING)

    def whole(c: str):
        return F.coalesce(F.col(c).cast("long"), missing)

    def named(c: str):
        # a null in a key would turn the whole numbers beside it into floats on their way
        return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))

    def row(kind: int, salt, mac: str, **columns):
        asked = {c: F.lit(None).cast("string") for c in ("eth_src", "eth_dst")}
        asked |= {"in_port": missing, "ethertype": missing} | columns
        return F.struct(
            F.lit(kind).alias("kind"), salt.cast("int").alias("salt"), named(mac).alias("mac"), us.alias("us"),
            whole("seq").alias("seq"), *[asked[c].alias(c) for c in ("eth_src", "eth_dst", "in_port", "ethertype")],
            (whole("in_port") if kind == LESSON else missing).alias("port"))

    lessons = [row(LESSON, F.lit(i), "eth_src") for i in range(salts)]
    question = row(
        QUESTION, F.pmod(F.xxhash64("seq", "event_ts"), F.lit(salts)), "eth_dst", eth_src=F.col("eth_src"),
        eth_dst=F.col("eth_dst"), in_port=whole("in_port"), ethertype=whole("ethertype"))
    # a filter would be moved below the watermark, which these frames are to move
    discovery = F.col("ethertype").eqNullSafe(F.lit(ETHERTYPE_LLDP))
    rows = F.when(~discovery & F.col("event_ts").isNotNull(), F.array(*lessons, question))
    state = T.StructType.fromDDL(
        "kind int, us long, seq long, eth_src string, eth_dst string, in_port long, ethertype long, port long, "
        "dpid long, mac string")
    out = T.StructType.fromDDL(
        "us long, seq long, dpid long, in_port long, eth_src string, eth_dst string, ethertype long, learned long")
    decided = (
        packets.withWatermark("event_ts", late)
        .select("event_ts", whole("dpid").alias("dpid"), F.inline(rows))
        .withColumn("bucket", F.pmod(F.xxhash64("dpid", "mac", "salt"), F.lit(buckets)).cast("int"))
        .drop("salt")
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=LearnedPorts(state, out.fieldNames()), outputStructType=out,
            outputMode="Append", timeMode="EventTime"))

    def back(c: str, kind: T.DataType):
        return F.nullif(F.col(c), missing).cast(kind).alias(c)

    kinds = {f.name: f.dataType for f in packets.schema}
    return decided.select(
        F.timestamp_micros("us").alias("event_ts"), *[back(c, kinds[c]) for c in ("seq", "dpid", "in_port")],
        "eth_src", "eth_dst", back("ethertype", kinds["ethertype"]),
        F.coalesce(F.nullif(F.col("learned"), missing).cast("string"), F.lit(FLOOD)).alias("out_port"))


def port_table(spark, path: str) -> KeptTable:
    """The newest port of each source address, as ``keep_last_known_port`` leaves it."""
    return KeptTable(spark, path, "dpid long, eth_src string, port int", ["dpid", "eth_src"])


def device_table(spark, path: str) -> KeptTable:
    """Whether each device is live, as ``keep_live_devices`` leaves it; filter by ``live``."""
    return KeptTable(spark, path, "dpid long, live boolean", ["dpid"])


def keep_last_known_port(packets: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep ``last_known_port`` of a stream as a table; each micro-batch writes what it changes."""
    return _kept(last_known_port(packets), port_table(packets.sparkSession, path), checkpoint, trigger)


def keep_live_devices(
    states: DataFrame, path: str, checkpoint: str, tiebreak: str | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the newest state of each device of a stream as a table; devices go dead in it too."""
    live = F.max_by(F.col("state") == F.lit(DEVICE_LIVE), order_key("event_ts", tiebreak))
    newest = states.groupBy("dpid").agg(live.alias("live"))
    return _kept(newest, device_table(states.sparkSession, path), checkpoint, trigger)


def _kept(changes: DataFrame, table: KeptTable, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        changes.writeStream.outputMode("update").foreachBatch(lambda rows, i: table.upsert(rows, i) and None)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
