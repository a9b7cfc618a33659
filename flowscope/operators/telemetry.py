"""Aggregates and lookups over the telemetry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowscope.functions import round_np, without_nan
from flowscope.sizing import small_or_same

BINS_PER_E = 4096
#: equal parts that a bin with a wanted rank is cut into, and rows of a bin that need no cutting
CELLS, FEW_ROWS = 4_096, 1_000_000


def positive_or_all(df: DataFrame, col: str) -> DataFrame:
    """Rows with a positive ``col``; all rows when there is no such row."""
    return df.filter(positive_or_none(df, col))


def positive_or_none(df: DataFrame, col: str) -> Column:
    """True on rows with a positive ``col``, or everywhere when no row has one."""
    positive = without_nan(col) > 0
    seen = df.agg(F.coalesce(F.bool_or(positive), F.lit(False)).alias("seen"))
    return F.coalesce(positive, F.lit(False)) | ~seen.scalar()


def min_event_time(df: DataFrame, by: str | None = None) -> DataFrame:
    first = F.min(without_nan("timestamp")).alias("min_timestamp")
    return df.groupBy(by).agg(first) if by else df.agg(first)


def scenario_t0(metrics: DataFrame, timing: DataFrame) -> DataFrame:
    """Start of each scenario in ``metrics``: its first recorded start, else its first event.

    Both tables go through one aggregation, so there is nothing to join.
    """
    nothing = F.lit(None).cast("double")
    recorded = timing.select(
        "scenario", F.col("scenario_start_time").alias("start"), nothing.alias("event"))
    events = metrics.select(
        "scenario", nothing.alias("start"), without_nan("timestamp").alias("event"))
    return (
        recorded.unionByName(events)
        .filter(F.col("scenario").isNotNull())
        .groupBy("scenario")
        .agg(F.min("start").alias("start"), F.min("event").alias("event"))
        .filter(F.col("event").isNotNull())
        .select("scenario", F.coalesce("start", "event").alias("t0"))
    )


def global_t0(metrics: DataFrame, timing: DataFrame) -> DataFrame:
    """One row: the first recorded run start, else the first event."""
    run = timing.agg(F.min(without_nan("battery_start_time")).alias("t0"))
    event = F.min(without_nan("timestamp"))
    return metrics.agg(event.alias("event")).select(
        F.coalesce(run.scalar(), F.col("event")).alias("t0"))


def relative_time(
    df: DataFrame, t0: DataFrame, out: str = "scenario_time_sec"
) -> DataFrame:
    """Add ``out``: seconds since ``t0``, a one-row, one-column frame."""
    return df.withColumn(out, F.col("timestamp") - t0.scalar())


def unique_port_rate(binned: DataFrame, width: float = 2) -> DataFrame:
    """Distinct ports per second in each time bin; repeated ports collapse before the shuffle."""
    ports = F.countDistinct("dst_port") / F.lit(float(width))
    return binned.groupBy("time_bin").agg(ports.alias("ports_per_sec"))


def drop_markers(drops: DataFrame, bins: DataFrame) -> DataFrame:
    """Each DROP event with the rate of its bin, 0 when the bin is not there."""
    rates = small_or_same(bins.select("time_bin", "ports_per_sec"))
    return drops.join(rates, "time_bin", "left").withColumn(
        "ports_per_sec", F.coalesce("ports_per_sec", F.lit(0.0)))


def action_counts(metrics: DataFrame) -> DataFrame:
    """Samples per scenario, prediction and action; rows with a null key are not counted."""
    keys = ["scenario", "predicted_label", "action_taken"]
    return metrics.na.drop("any", subset=keys).groupBy(*keys).agg(F.count("*").alias("samples"))


def class_summary(df: DataFrame, label: str = "label") -> DataFrame:
    """Sample count per class name."""
    return df.groupBy(label).agg(F.count("*").alias("samples"))


def _cut_again(values: DataFrame, by: str, hit_bins: DataFrame, ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values of the bins that are hit with their equal cells, and the cells that hold a wanted rank.

    Values may crowd in one bin, so each is cut between its own ends.
    """
    part = F.floor((F.col("v") - F.col("low")) / (F.col("top") - F.col("low")) * F.lit(CELLS))
    cell = F.when(F.col("top") > F.col("low"), part).otherwise(F.lit(0)).alias("cell")
    fine = values.join(hit_bins.select(by, "bin", "low", "top"), [by, "bin"]).select(by, "bin", "v", cell)
    cells = fine.groupBy(by, "bin", "cell").agg(F.count("*").alias("n"))
    in_bin = W.partitionBy(by, "bin").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    hit_cells = (
        cells.withColumn("less", F.sum("n").over(in_bin) - F.col("n"))
        .join(ranks.select(by, "bin", "before", "lower", "upper"), [by, "bin"])
        .withColumn("before", F.col("before") + F.col("less"))
        .filter((F.col("lower") < F.col("before") + F.col("n")) & (F.col("upper") >= F.col("before")))
        .select(by, "bin", "cell", "before").distinct()
    )
    return fine, hit_cells


def exact_percentiles(
    df: DataFrame, by: str, col: str, probs: dict[str, float], few_rows: int = FEW_ROWS,
) -> DataFrame:
    """Count, mean, max and exact linearly interpolated percentiles of ``col`` per ``by``.

    The built-in exact ``percentile`` keeps every distinct value of a group in one buffer.
    Here a first pass counts values in fine bins of a rising function of the value, which
    tells the bin that holds each wanted rank. Where such a bin holds more than ``few_rows``, a
    second pass counts again in equal cells of those bins. The last one sorts the distinct
    values of the cells hit only. A group without any value gets nulls.
    """
    value = without_nan(F.col(col).cast("double"))
    values = (
        df.filter(F.col(by).isNotNull())
        .select(by, value.alias("v"))
        .withColumn("bin", F.floor(F.asinh(F.abs("v")) * F.signum("v") * F.lit(BINS_PER_E)))
    )
    histogram = values.groupBy(by, "bin").agg(
        F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("top"))

    group = W.partitionBy(by)
    running = group.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    counted = histogram.select(
        by, "bin", "n", "low", "top",
        (F.sum("n").over(running) - F.col("n")).alias("before"),
        F.sum("n").over(group).alias("size"),
        F.try_divide(F.sum("total").over(group), F.sum("n").over(group)).alias("mean"),
        F.max("top").over(group).alias("max"),
    )
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), ((F.col("size") - 1) * F.lit(float(p))).alias("at"))
        for name, p in probs.items()
    ])
    ranks = (
        counted.select("*", F.explode(wanted).alias("want"))
        .select("*", "want.name", "want.at")
        .withColumn("lower", F.floor("at"))
        .withColumn("upper", F.ceil("at"))
        # the two ranks around a point may lie in two bins
        .filter(
            (F.col("size") == 0)
            | ((F.col("lower") < F.col("before") + F.col("n")) & (F.col("upper") >= F.col("before")))
        )
        .select(by, "bin", "n", "before", "low", "top", "size", "mean", "max", "name", "lower", "upper")
    )
    ranks = small_or_same(ranks)
    hit_bins = ranks.select(by, "bin", "n", "before", "low", "top").distinct()
    if (hit_bins.agg(F.max("n")).first()[0] or 0) <= few_rows:
        # no bin that is hit holds much, so its values are sorted as they are
        whole = F.lit(0).cast("long").alias("cell")
        fine = values.join(hit_bins.select(by, "bin"), [by, "bin"]).select(by, "bin", "v", whole)
        hit_cells = hit_bins.select(by, "bin", whole, "before")
    else:
        fine, hit_cells = _cut_again(values, by, hit_bins, ranks)
    spread = (
        fine.join(small_or_same(hit_cells), [by, "bin", "cell"])
        .groupBy(by, "bin", "cell", "before", "v").agg(F.count("*").alias("n"))
    )
    within = W.partitionBy(by, "bin", "cell").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    placed = spread.withColumn("stop", F.col("before") + F.sum("n").over(within)).select(
        by, "bin", "v", (F.col("stop") - F.col("n")).alias("start"), "stop")

    def at_rank(rank: str) -> Column:
        here = (F.col("start") <= F.col(rank)) & (F.col(rank) < F.col("stop"))
        return F.when(here, F.col("v"))

    found = placed.join(ranks, [by, "bin"]).select(
        by, "name", "size", "mean", "max", at_rank("lower").alias("a"), at_rank("upper").alias("b"))
    # the ranks themselves keep groups in that have no value
    points = found.unionByName(ranks.select(by, "name", "size", "mean", "max"), allowMissingColumns=True)

    def of(name: str, c: str) -> Column:
        return F.max(F.when(F.col("name") == F.lit(name), F.col(c))).alias(f"{name}_{c}")

    ends = points.groupBy(by).agg(
        F.max("size").alias("n"), F.max("mean").alias("mean"), F.max("max").alias("max"),
        *[of(name, c) for name in probs for c in ("a", "b")])

    def between(name: str, p: float) -> Column:
        at = (F.col("n") - 1) * F.lit(float(p))
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        return (a + (b - a) * (at - F.floor(at))).alias(name)

    return ends.select(by, "n", "mean", "max", *[between(name, p) for name, p in probs.items()])


def inference_stats(metrics: DataFrame, exact: bool = True) -> DataFrame:
    """Mean, median, maximum and 95th percentile of the inference time per scenario."""
    probs = {"median": 0.5, "p95": 0.95}
    if exact:
        stats = exact_percentiles(metrics, "scenario", "inference_time_ms", probs)
    else:
        ms = without_nan("inference_time_ms")
        stats = (
            metrics.filter(F.col("scenario").isNotNull())
            .groupBy("scenario")
            .agg(
                F.avg(ms).alias("mean"), F.max(ms).alias("max"),
                *[F.percentile_approx(ms, p).alias(name) for name, p in probs.items()],
            )
        )
    return stats.select(
        "scenario", *[round_np(c, 3).alias(c) for c in ("mean", "median", "max", "p95")])
