"""Readers and writers of the telemetry tables, all with declared schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowscope.functions import round_np
from flowscope.schemas import (
    CSV_HEADERS,
    FLOW_STATS,
    METRIC_DIGITS,
    METRICS,
    NA_TOKENS,
    RAW_FLOWS,
    TIMING,
)


FILES_PER_TRIGGER = 100


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def _without_na(df: DataFrame) -> DataFrame:
    """Text that stands for a missing value becomes null."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(NA_TOKENS), F.col(c)) for c in texts})


def read_flow_stats(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    fmt: str = "parquet",
    files_per_trigger: int | None = FILES_PER_TRIGGER,
) -> DataFrame:
    """Flow-counter polls from a folder, as a table or as a stream of new files.

    A micro-batch takes ``files_per_trigger`` files; None takes a whole backlog at once.
    """
    if not streaming:
        return spark.read.schema(FLOW_STATS).format(fmt).load(path)
    reader = spark.readStream.schema(FLOW_STATS).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def read_raw_flows(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The labelled dataset; CSV carries the interchange headers, parquet our names."""
    try:
        if fmt != "csv":
            return spark.read.schema(RAW_FLOWS).format(fmt).load(path)
        named = T.StructType([
            T.StructField(CSV_HEADERS[f.name], f.dataType) for f in RAW_FLOWS])
        raw = (
            spark.read.schema(named)
            .option("header", True)
            .option("enforceSchema", False)
            .csv(path)
        )
    except AnalysisException as e:
        if _missing(e):
            raise FileNotFoundError(f"no dataset at '{path}': record traffic first") from e
        raise
    return _without_na(raw.toDF(*RAW_FLOWS.fieldNames()))


class MalformedRowsError(ValueError):
    """A dataset has more malformed rows than allowed."""


def split_raw_flows(spark: SparkSession, path: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, malformed) rows of the labelled dataset in CSV.

    A row is malformed when it has too few or too many fields, or a field that is no value
    of its column; ``read_raw_flows`` makes such a field null, and cleaning then drops the
    row without a word. Malformed rows come as ``line``, the text of the row. Fields that
    stand for a missing value are not malformed. With ``most`` the malformed rows are
    counted at once, and more of them raise ``MalformedRowsError``.
    """
    names = list(CSV_HEADERS.values())
    texts = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("line", T.StringType())])
    try:
        # all fields as text, so that what a number is gets decided below, with missing values known
        rows = (
            spark.read.schema(texts).option("header", True).option("enforceSchema", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "line").csv(path))
    except AnalysisException as e:
        if _missing(e):
            raise FileNotFoundError(f"no dataset at '{path}': record traffic first") from e
        raise
    given = {f.name: F.col(f"`{n}`") for n, f in zip(names, RAW_FLOWS)}
    rows = rows.select("line", *[F.when(~c.isin(NA_TOKENS), c).alias(n) for n, c in given.items()])
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in RAW_FLOWS}
    wrong = F.col("line").isNotNull()
    for name, value in typed.items():
        wrong = wrong | (value.isNull() & F.col(name).isNotNull())
    shown = F.coalesce("line", F.concat_ws(",", *[F.coalesce(F.col(f.name), F.lit("")) for f in RAW_FLOWS]))
    malformed = rows.filter(wrong).select(shown.alias("line"))
    if most is not None and (n := malformed.count()) > most:
        raise MalformedRowsError(f"{n} malformed rows at '{path}', {most} allowed")
    return rows.filter(~wrong).select(*[v.alias(n) for n, v in typed.items()]), malformed


def _file_rows(df: DataFrame, fmt: str) -> DataFrame:
    rows = df.select(*RAW_FLOWS.fieldNames())
    return rows.toDF(*CSV_HEADERS.values()) if fmt == "csv" else rows


def append_raw_flows(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    checkpoint: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery | None:
    """Append labelled rows.

    A stream needs a ``checkpoint`` folder and returns its query; ``trigger`` is passed on,
    and by default it takes what there is and stops.
    """
    rows = _file_rows(df, fmt)
    if df.isStreaming:
        return (
            rows.writeStream.format(fmt).option("header", True).outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start(path)
        )
    rows.write.mode("append").format(fmt).option("header", True).save(path)
    return None


def metric_rows(df: DataFrame) -> DataFrame:
    """Rows of the telemetry table: stamped now unless they carry a time, and rounded."""
    if "timestamp" not in df.columns:
        now = F.unix_micros(F.current_timestamp()) / F.lit(1e6)
        df = df.withColumn("timestamp", now)
    rounded = df.withColumns({c: round_np(c, d) for c, d in METRIC_DIGITS.items()})
    return rounded.select(*[F.col(f.name).cast(f.dataType) for f in METRICS])


def append_metrics(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append telemetry rows; parquet is laid out by scenario, so a report reads its own."""
    writer = metric_rows(df).write.mode("append").format(fmt).option("header", True)
    if fmt == "parquet":
        writer = writer.partitionBy("scenario")
    writer.save(path)


def read_metrics_timing(
    spark: SparkSession, folder: str, fmt: str = "parquet"
) -> tuple[DataFrame, DataFrame] | tuple[None, None]:
    """(metrics, timing) from ``folder``; no metrics gives None, no timing an empty table."""

    def read(name: str, schema: T.StructType) -> DataFrame | None:
        try:
            table = (
                spark.read.schema(schema).format(fmt).option("header", True)
                .load(f"{folder}/{name}")
            )
        except AnalysisException as e:
            if _missing(e):
                return None
            raise
        return _without_na(table.select(*schema.fieldNames()))

    metrics = read("metrics", METRICS)
    if metrics is None:
        return None, None
    timing = read("timing", TIMING)
    return metrics, spark.createDataFrame([], TIMING) if timing is None else timing


def append_timing(
    spark: SparkSession,
    path: str,
    scenario: str,
    start: float,
    run_start: float | None = None,
    fmt: str = "parquet",
) -> None:
    """Record the start of a scenario; outside a full run there is no run start."""
    row = [(scenario, float(start), float(run_start) if run_start else None)]
    table = spark.createDataFrame(row, TIMING)
    table.coalesce(1).write.mode("append").format(fmt).option("header", True).save(path)


def save_split(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(train, test); each reads only its own folder."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if _missing(e):
            raise FileNotFoundError(f"no processed data at '{path}': prepare it first") from e
        raise
    return tuple(rows.filter(F.col("split") == s).drop("split") for s in ("train", "test"))


def write_result(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
