"""Mergeable summaries of telemetry, kept per bin or scenario and merged later.

The exact operators read every row again for each question. A sketch of a bin is a few
kilobytes whatever it stands for; sketches of bins make those of longer bins, and sketches of
runs those of all runs. All of it is built-in aggregation with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.functions import relative_bin, without_nan

#: 2 ** PORT_BITS registers: the relative standard error is 1.04 / sqrt of that, 1.6 %
PORT_BITS = 12
#: a quantile's rank is off by about 1.3 % of the rows at most, with 99 % confidence
RANK_ACCURACY = 200
RANK_ERROR = 0.0165


def port_sketches(binned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A sketch of the distinct ports of each ``by`` (scenario and bin); null ports are not counted."""
    by = ["scenario", "time_bin"] if by is None else by
    return binned.groupBy(*by).agg(F.hll_sketch_agg("dst_port", PORT_BITS).alias("ports"))


def merge_port_sketches(sketches: DataFrame, width: float) -> DataFrame:
    """Sketches of bins of ``width`` seconds from those of shorter bins that divide it."""
    longer = sketches.withColumn("time_bin", relative_bin("time_bin", width))
    return longer.groupBy("scenario", "time_bin").agg(F.hll_union_agg("ports").alias("ports"))


def sketched_port_rate(sketches: DataFrame, width: float) -> DataFrame:
    """(scenario, time_bin, ports_per_sec) as ``unique_port_rate``, from sketches of bins of ``width``."""
    rate = F.hll_sketch_estimate("ports") / F.lit(float(width))
    return sketches.select("scenario", "time_bin", rate.alias("ports_per_sec"))


def time_sketches(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per scenario a quantile sketch of the inference times, their number, sum and maximum."""
    ms = without_nan("inference_time_ms")
    return metrics.filter(F.col("scenario").isNotNull()).groupBy(*(by or ["scenario"])).agg(
        F.kll_sketch_agg_double(ms, RANK_ACCURACY).alias("times"),
        F.count(ms).alias("n"), F.sum(ms).alias("total"), F.max(ms).alias("max"))


def merge_time_sketches(sketches: DataFrame) -> DataFrame:
    """One sketch per scenario from those of its runs."""
    return sketches.groupBy("scenario").agg(
        F.kll_merge_agg_double("times").alias("times"), F.sum("n").alias("n"),
        F.sum("total").alias("total"), F.max("max").alias("max"))


def sketched_inference_stats(sketches: DataFrame) -> DataFrame:
    """As ``inference_stats``, unrounded; median and p95 within ``RANK_ERROR`` of their rank.

    Number, mean and maximum are exact. A scenario without times has nulls.
    """
    def quantile(p: float):
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("times", F.lit(p)))

    return sketches.select(
        "scenario", "n", F.try_divide("total", "n").alias("mean"), quantile(0.5).alias("median"), "max",
        quantile(0.95).alias("p95"))
