"""Score flow rows as they arrive, decide an action and log it."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowscope.schemas import ALLOW, DEFAULT_SCENARIO, DROP, METRICS
from flowscope.sources.files import metric_rows
from flowscope.sources.ledger import RowLog


def score_flows(stream: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``predicted_label`` to feature rows (batch or stream)."""
    scored = model.transform(stream)
    return scored.select(*stream.columns, "predicted_label")


def decide_action(df: DataFrame) -> DataFrame:
    """Add ``action_taken``: drop whatever is predicted to be an attack."""
    attack = F.col("predicted_label") != F.lit(DEFAULT_SCENARIO)
    return df.withColumn("action_taken", F.when(attack, F.lit(DROP)).otherwise(F.lit(ALLOW)))


@contextmanager
def telemetry_rows(features: DataFrame, model: PipelineModel, event_ts: str = "event_ts") -> Iterator[DataFrame]:
    """The telemetry of the rows of one micro-batch, scored once, while the block runs.

    The inference time is the wall time of scoring alone per row; the latency of a drop is
    the time from the poll to its processing.
    """
    rows = features.persist()
    scored = decide_action(score_flows(rows, model)).persist()
    try:
        n = rows.count()
        begin = time.monotonic()
        scored.count()
        per_row = (time.monotonic() - begin) * 1000.0 / max(n, 1)
        now = time.time()
        late_ms = (F.lit(now) - F.unix_micros(event_ts) / F.lit(1e6)) * 1000.0
        dropped = F.col("action_taken") == F.lit(DROP)
        yield metric_rows(scored.withColumns({
            "timestamp": F.lit(now),
            "inference_time_ms": F.lit(per_row),
            "mitigation_latency_ms": F.when(dropped, late_ms).otherwise(F.lit(0.0)),
        }))
    finally:
        scored.unpersist()
        rows.unpersist()


def emit_batch(
    features: DataFrame, model: PipelineModel, path: str, batch_id: int, event_ts: str = "event_ts"
) -> None:
    """Score the rows of one micro-batch and write their telemetry; see ``telemetry_rows``.

    Every micro-batch owns one folder, laid out by scenario, and overwrites it when it is run
    again, so a retry leaves no doubles.
    """
    with telemetry_rows(features, model, event_ts) as rows:
        rows.write.mode("overwrite").partitionBy("scenario").parquet(f"{path}/batch_id={batch_id}")


def telemetry_log(spark, path: str) -> RowLog:
    """Telemetry rows of a stream, once each; what reports read."""
    return RowLog(spark, path, METRICS, "scenario")


def log_batch(
    features: DataFrame, model: PipelineModel, log: RowLog, batch_id: int, event_ts: str = "event_ts",
    compact_every: int = 100,
) -> None:
    """As ``emit_batch`` into a log, whose many small folders every so often become one."""
    with telemetry_rows(features, model, event_ts) as rows:
        log.append(rows, batch_id)
    if (batch_id + 1) % compact_every == 0:
        log.compact()
        log.ledger.vacuum()


def emit_metrics(
    stream: DataFrame,
    model: PipelineModel,
    path: str,
    checkpoint: str,
    event_ts: str = "event_ts",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append one telemetry row per feature row of a stream; see ``emit_batch``.

    The rows carry the features and the telemetry columns that scoring does not add.
    """
    return (
        stream.writeStream
        .foreachBatch(lambda batch, i: emit_batch(batch, model, path, i, event_ts))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
