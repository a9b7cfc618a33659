"""The driver's tables seen as telemetry tables.

Each view is a projection of ``events`` (or ``embeddings``), so it grows with the table
and adds no shuffle of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.schemas import DEFAULT_SCENARIO, METRICS, SCENARIOS

DAY = 86_400


def events(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return (
        spark.read.parquet(f"{folder}/events.parquet")
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .drop("props")
    )


def _scenario(place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SCENARIOS]), place.cast("int") + 1)


def _predicted() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "click", "ddos")
        .when(kind == "purchase", "scanning")
        .when(kind == "signup", "spoofing")
        .otherwise(DEFAULT_SCENARIO)
    )


def metrics(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    dropped = (F.col("predicted_label") != DEFAULT_SCENARIO) & (F.col("k") >= 50)
    table = events(spark, folder).withColumns({
        "timestamp": F.unix_micros("ts") / F.lit(1e6),
        "dpid": F.col("user_id") % 3 + 1,
        "in_port": (F.col("user_id") % 5 + 1).cast("int"),
        "eth_src": F.concat(F.lit("u"), F.col("user_id")),
        "dst_port": F.col("k"),
        "pkt_rate": F.col("value"),
        "byte_rate": F.col("value") * 64,
        "inference_time_ms": F.col("value"),
        "mitigation_latency_ms": F.when(
            F.col("event_type") == "error", F.col("value")).otherwise(0.0),
        "cpu_percent": F.col("k").cast("double"),
        "predicted_label": _predicted(),
        "scenario": _scenario(F.col("user_id") % 4),
    }).withColumn("action_taken", F.when(dropped, "DROP").otherwise("ALLOW"))
    return table.select(*keep, *METRICS.fieldNames())


def timing(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded starts of all scenarios but one, a minute before their first event."""
    start = F.min("timestamp") - 60.0
    return (
        metrics(spark, folder)
        .filter(F.col("scenario") != "spoofing")
        .groupBy("scenario")
        .agg(start.alias("scenario_start_time"))
        .withColumn("battery_start_time", F.when(
            F.col("scenario") != "normal", F.col("scenario_start_time") - 5.0))
    )


def flow_stats(spark: SparkSession, folder: str, resets: bool = True, keep: tuple = ()) -> DataFrame:
    """One flow per user; counters that fall back now and then, or that only rise."""
    if resets:
        packets = F.col("k").cast("long")
        octets = F.floor(F.col("value") * 100.0)
    else:
        packets = F.col("event_id")
        octets = F.col("event_id") * 100 + F.col("k")
    user = F.col("user_id")
    return events(spark, folder).select(
        *keep,
        F.col("ts").alias("event_ts"),
        (user % 3 + 1).alias("dpid"),
        (user % 2).cast("int").alias("table_id"),
        F.create_map(
            F.lit("u"), user.cast("string"), F.lit("in_port"), (user % 5).cast("string"),
        ).alias("match"),
        packets.alias("packet_count"),
        octets.alias("byte_count"),
        (user * 10 + F.col("k")).alias("duration_sec"),
        ((F.col("event_id") * 7919) % 1_000_000_000).alias("duration_nsec"),
        (user % 2).cast("int").alias("priority"),
        (F.col("k") % 3).alias("hard_timeout"),
        (F.col("k") % 5).alias("idle_timeout"),
        (F.col("event_id") % 2).cast("int").alias("flags"),
    )


def scenario_log(spark: SparkSession, folder: str) -> DataFrame:
    """One scenario change per hour, at and by the hour's first event."""
    hour = F.floor(F.unix_seconds("ts") / F.lit(3600))
    first = F.min_by("k", "event_id")
    return (
        events(spark, folder).groupBy(hour.alias("hour"))
        .agg(first.alias("k"), F.min("ts").alias("start_ts"), F.min("event_id").alias("seq"))
        .select(_scenario(F.col("k") % 4).alias("scenario"), "start_ts", "seq")
    )


def long_scenario_log(spark: SparkSession, folder: str) -> DataFrame:
    """A scenario change at every sign-up, so the log grows with the table."""
    return events(spark, folder).filter(F.col("event_type") == "signup").select(
        _scenario(F.col("k") % 4).alias("scenario"),
        F.col("ts").alias("start_ts"),
        F.col("event_id").alias("seq"),
    )


def recording_windows(spark: SparkSession, folder: str) -> DataFrame:
    """One window per day, from the first sign-up to the last error."""
    day = F.floor(F.unix_seconds("ts") / F.lit(DAY))
    kind = F.col("event_type")
    return (
        events(spark, folder).groupBy(day.alias("session_id"))
        .agg(
            F.min(F.when(kind == "signup", F.col("ts"))).alias("start_ts"),
            F.max(F.when(kind == "error", F.col("ts"))).alias("end_ts"),
        )
        .filter(F.col("start_ts") < F.col("end_ts"))
    )


def packet_in(spark: SparkSession, folder: str) -> DataFrame:
    lldp = F.when(F.col("event_type") == "error", 0x88CC).otherwise(0x0800)
    return events(spark, folder).select(
        F.col("ts").alias("event_ts"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 3).alias("dpid"),
        (F.col("user_id") % 5).cast("int").alias("in_port"),
        F.col("user_id").cast("string").alias("eth_src"),
        F.col("k").cast("string").alias("eth_dst"),
        lldp.alias("ethertype"),
    )


def device_state(spark: SparkSession, folder: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "DEAD").otherwise("MAIN")
    return events(spark, folder).select(
        F.col("ts").alias("event_ts"),
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("dpid"),
        state.alias("state"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """One model per device, which predicted the scenario."""
    return metrics(spark, folder).select(
        F.concat(F.lit("m"), F.col("dpid")).alias("model"),
        F.col("scenario").alias("label"),
        F.col("predicted_label").alias("prediction"),
    )


def dirty_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with infinities, NaN and nulls, and many copies."""
    k = F.col("k")
    reading = (
        F.when(k == 0, F.lit(float("inf"))).when(k == 1, F.lit(float("-inf")))
        .when(k == 2, F.lit(float("nan"))).when(k == 3, F.lit(None))
        .otherwise(F.floor(F.col("value") / 10.0).cast("double"))
    )
    return events(spark, folder).select(
        reading.alias("reading"),
        (k % 10).alias("level"),
        F.when(k != 4, F.col("event_type")).alias("label"),
    )


def vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """``embeddings`` as one column per dimension with a class name."""
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    width = 64
    names = [f"e{i}" for i in range(width)]
    cols = [F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]
    label = F.concat(F.lit("c"), F.col("label").cast("string"))
    return table.select("vec_id", *cols, label.alias("label")), names


def telling_flows(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    """Labelled flows whose class shows in their rates, so that every sound model finds it.

    The classes stand at the corners of a square of packet and byte rates, which noise does
    not reach across.
    """
    kind = F.col("user_id") % 4  # places in SCENARIOS: normal, ddos, scanning, spoofing
    noise = F.col("k") / F.lit(10.0)
    rows = events(spark, folder).select(
        *keep,
        F.col("ts").alias("event_ts"),
        (F.col("user_id") % 3 + 1).alias("dpid"),
        F.col("user_id").cast("string").alias("flow_key"),
        (F.col("k") + F.col("event_id") / F.lit(1e6)).alias("flow_duration"),
        (F.when(kind.isin(1, 2), 1000.0).otherwise(10.0) + noise).alias("pkts_per_s"),
        (F.when(kind.isin(1, 3), 5000.0).otherwise(50.0) + noise).alias("byts_per_s"),
        noise.alias("pkt_len_mean"),
        (F.col("event_id") * 3).alias("byte_count"),
        F.col("event_id").alias("packet_count"),
        *[F.lit(0).alias(c) for c in ("priority", "table_id", "hard_timeout", "idle_timeout", "flags")],
        _scenario(kind).alias("label"),
    )
    return rows
