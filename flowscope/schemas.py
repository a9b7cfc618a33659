"""Declared schemas and fixed values of the telemetry data model."""

from __future__ import annotations

from pyspark.sql import types as T

FLOW_STATS = T.StructType([
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("dpid", T.LongType()),
    T.StructField("table_id", T.IntegerType()),
    T.StructField("match", T.MapType(T.StringType(), T.StringType())),
    T.StructField("packet_count", T.LongType()),
    T.StructField("byte_count", T.LongType()),
    T.StructField("duration_sec", T.LongType()),
    T.StructField("duration_nsec", T.LongType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("hard_timeout", T.IntegerType()),
    T.StructField("idle_timeout", T.IntegerType()),
    T.StructField("flags", T.IntegerType()),
])

RAW_FLOWS = T.StructType([
    T.StructField("flow_duration", T.DoubleType()),
    T.StructField("pkts_per_s", T.DoubleType()),
    T.StructField("byts_per_s", T.DoubleType()),
    T.StructField("pkt_len_mean", T.DoubleType()),
    T.StructField("byte_count", T.LongType()),
    T.StructField("packet_count", T.LongType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("table_id", T.IntegerType()),
    T.StructField("hard_timeout", T.IntegerType()),
    T.StructField("idle_timeout", T.IntegerType()),
    T.StructField("flags", T.IntegerType()),
    T.StructField("label", T.StringType()),
])

METRICS = T.StructType([
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("dpid", T.LongType()),
    T.StructField("in_port", T.IntegerType()),
    T.StructField("eth_src", T.StringType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("pkt_rate", T.DoubleType()),
    T.StructField("byte_rate", T.DoubleType()),
    T.StructField("inference_time_ms", T.DoubleType()),
    T.StructField("mitigation_latency_ms", T.DoubleType()),
    T.StructField("cpu_percent", T.DoubleType()),
    T.StructField("predicted_label", T.StringType()),
    T.StructField("action_taken", T.StringType()),
    T.StructField("scenario", T.StringType()),
])

TIMING = T.StructType([
    T.StructField("scenario", T.StringType()),
    T.StructField("scenario_start_time", T.DoubleType()),
    T.StructField("battery_start_time", T.DoubleType()),
])

SCENARIO_LOG = T.StructType([
    T.StructField("scenario", T.StringType()),
    T.StructField("start_ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
])

RECORDING_WINDOWS = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("start_ts", T.TimestampType()),
    T.StructField("end_ts", T.TimestampType()),
])

PACKET_IN = T.StructType([
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("dpid", T.LongType()),
    T.StructField("in_port", T.IntegerType()),
    T.StructField("eth_src", T.StringType()),
    T.StructField("eth_dst", T.StringType()),
    T.StructField("ethertype", T.IntegerType()),
])

DEVICE_STATE = T.StructType([
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("dpid", T.LongType()),
    T.StructField("state", T.StringType()),
])

# Column names of the CSV interchange file, in file order.
CSV_HEADERS = {
    "flow_duration": "Flow Duration",
    "pkts_per_s": "Flow Pkts/s",
    "byts_per_s": "Flow Byts/s",
    "pkt_len_mean": "Pkt Len Mean",
    "byte_count": "byte_count",
    "packet_count": "packet_count",
    "priority": "priority",
    "table_id": "table_id",
    "hard_timeout": "hard_timeout",
    "idle_timeout": "idle_timeout",
    "flags": "flags",
    "label": "Label",
}

# Rule metadata that is not a traffic feature.
METADATA = ["priority", "table_id", "hard_timeout", "idle_timeout", "flags"]

# Columns that tell rows apart but are no part of the labelled dataset.
IDENTITY = ["event_ts", "dpid", "flow_key"]

TRAFFIC_FEATURES = [
    "flow_duration", "pkts_per_s", "byts_per_s",
    "pkt_len_mean", "byte_count", "packet_count",
]

# The traffic scenarios, which are also the class names.
SCENARIOS = ["normal", "ddos", "scanning", "spoofing"]
DEFAULT_SCENARIO = "normal"

# Actions, device states and the link-discovery ethertype.
DROP = "DROP"
ALLOW = "ALLOW"
FLOOD = "FLOOD"
DEVICE_LIVE = "MAIN"
ETHERTYPE_LLDP = 0x88CC

# Decimal digits kept in the telemetry table.
METRIC_DIGITS = {
    "pkt_rate": 2,
    "byte_rate": 2,
    "inference_time_ms": 3,
    "mitigation_latency_ms": 3,
    "cpu_percent": 2,
}

# Text that the pandas CSV reader takes as missing by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Learning parameters.
N_FEATURES = 10
TEST_SIZE = 0.20
SEED = 42
SELECTOR_TREES = 50
FOREST_TREES = 100
LOGISTIC_ITERATIONS = 1000
MODEL_NAMES = ["Logistic_Regression", "Decision_Tree", "Random_Forest"]
METRIC_COLUMNS = ["Accuracy", "Precision", "Recall", "F1-Score"]
