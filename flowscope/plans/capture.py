"""Polled counters to the labelled dataset, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowscope.functions import flow_key
from flowscope.operators.counters import (
    active_only,
    counter_deltas,
    flow_features,
    flow_rates,
    min_gap,
)
from flowscope.operators.intervals import label_by_scenario, within_recording
from flowscope.operators.ordered import ROWS_PER_CHUNK
from flowscope.schemas import IDENTITY


def with_flow_key(flow_stats: DataFrame) -> DataFrame:
    """Replace the match map by the flow identity, which can be shuffled and sorted on."""
    return flow_stats.withColumn("flow_key", flow_key("dpid", "table_id", "match")).drop("match")


def rated(deltas: DataFrame, gap: float = 0.1) -> DataFrame:
    """Rates of the samples that pass the gap and activity gates."""
    return flow_rates(active_only(min_gap(deltas, gap)))


def capture(
    flow_stats: DataFrame,
    scenario_log: DataFrame,
    recording_windows: DataFrame,
    tiebreak: str | None = None,
    gap: float = 0.1,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Labelled feature rows of all recorded polls, with the columns that identify them.

    Polls outside a recording window go first, so only recorded rows are shuffled.
    """
    recorded = within_recording(with_flow_key(flow_stats), recording_windows)
    deltas = counter_deltas(
        recorded, "flow_key", tiebreak=tiebreak, session="session_id",
        rows_per_chunk=rows_per_chunk)
    return flow_features(label_by_scenario(rated(deltas, gap), scenario_log), IDENTITY)
