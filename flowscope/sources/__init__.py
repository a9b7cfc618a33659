from flowscope.sources.artifacts import load_model, save_model
from flowscope.sources.files import (
    append_metrics,
    append_raw_flows,
    append_timing,
    load_split,
    metric_rows,
    read_flow_stats,
    read_metrics_timing,
    read_raw_flows,
    save_split,
    split_raw_flows,
    write_result,
)

__all__ = [
    "append_metrics", "append_raw_flows", "append_timing", "load_model", "load_split",
    "metric_rows", "read_flow_stats", "read_metrics_timing", "read_raw_flows",
    "save_model", "save_split", "split_raw_flows", "write_result",
]
