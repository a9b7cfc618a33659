from flowscope.functions.scalars import (
    class_name,
    finite,
    flow_duration,
    flow_key,
    order_key,
    relative_bin,
    round_np,
    without_nan,
)

__all__ = [
    "class_name", "finite", "flow_duration", "flow_key",
    "order_key", "relative_bin", "round_np", "without_nan",
]
