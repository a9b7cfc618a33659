"""The telemetry reports as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.functions import relative_bin
from flowscope.operators.cleaning import drop_events, for_scenario
from flowscope.operators.evaluation import melt_metrics, model_metrics
from flowscope.operators.telemetry import (
    action_counts,
    drop_markers,
    global_t0,
    inference_stats,
    positive_or_none,
    relative_time,
    scenario_t0,
    unique_port_rate,
)
from flowscope.schemas import DROP


def _from_start(metrics: DataFrame, timing: DataFrame, scenario: str) -> DataFrame:
    """Rows of one scenario with their seconds since its start.

    Only this scenario's rows are read, for the start as well as for the rows.
    """
    rows = for_scenario(metrics, scenario)
    t0 = scenario_t0(rows, for_scenario(timing, scenario)).select("t0")
    return relative_time(rows, t0)


def attack_timeline(metrics: DataFrame, timing: DataFrame, scenario: str) -> DataFrame:
    """Packet rate over the time of one scenario, with the DROP events marked."""
    is_drop = F.coalesce(F.col("action_taken") == F.lit(DROP), F.lit(False))
    return _from_start(metrics, timing, scenario).select(
        "scenario_time_sec", "pkt_rate", is_drop.alias("is_drop"))


def scan_bins(
    metrics: DataFrame, timing: DataFrame, width: float = 2, scenario: str = "scanning"
) -> DataFrame:
    """The scan's rows with the time bin each one falls in."""
    return _from_start(metrics, timing, scenario).withColumn(
        "time_bin", relative_bin("scenario_time_sec", width))


def scan_activity(metrics: DataFrame, timing: DataFrame, width: float = 2) -> DataFrame:
    """Unique ports per second and DROP events in each time bin of the scan."""
    ports = F.countDistinct("dst_port") / F.lit(float(width))
    drops = F.count_if(F.col("action_taken") == F.lit(DROP))
    return scan_bins(metrics, timing, width).groupBy("time_bin").agg(
        ports.alias("ports_per_sec"), drops.alias("drops"))


def scan_drop_markers(metrics: DataFrame, timing: DataFrame, width: float = 2) -> DataFrame:
    """Each DROP event of the scan at the height of its bin."""
    binned = scan_bins(metrics, timing, width)
    return drop_markers(drop_events(binned), unique_port_rate(binned, width)).select(
        "scenario_time_sec", "ports_per_sec")


def infrastructure_impact(metrics: DataFrame, timing: DataFrame) -> DataFrame:
    """Controller load and mitigation latency over the whole run.

    The latency is null on rows that are no part of its series: those without a positive
    latency, unless no row has one.
    """
    in_series = positive_or_none(metrics, "mitigation_latency_ms")
    latency = F.when(in_series, F.col("mitigation_latency_ms"))
    return relative_time(metrics, global_t0(metrics, timing), "global_time_sec").select(
        "global_time_sec", "cpu_percent", latency.alias("mitigation_latency_ms"))


def inference_summary(metrics: DataFrame, exact: bool = True) -> DataFrame:
    return inference_stats(metrics, exact)


def run_summary(metrics: DataFrame) -> DataFrame:
    return action_counts(metrics)


def model_comparison(predictions: DataFrame) -> DataFrame:
    """One row per model and metric."""
    return melt_metrics(model_metrics(predictions))


def report(
    metrics: DataFrame, timing: DataFrame, scenario: str | None = None, width: float = 2
) -> dict[str, DataFrame]:
    """All reports, or only that of one attack scenario.

    Each is its own lazy table. Nothing is cached: with the telemetry laid out by scenario
    a report reads its own partition and columns only.
    """
    single = {
        "ddos": lambda: attack_timeline(metrics, timing, "ddos"),
        "spoofing": lambda: attack_timeline(metrics, timing, "spoofing"),
        "scanning": lambda: scan_activity(metrics, timing, width),
    }
    if scenario is not None:
        if scenario not in single:
            raise ValueError(f"scenario must be one of {sorted(single)}")
        return {scenario: single[scenario]()}
    return {
        **{name: build() for name, build in single.items()},
        "infrastructure": infrastructure_impact(metrics, timing),
        "inference": inference_summary(metrics),
    }
