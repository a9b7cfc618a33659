"""Unique ports per second of a stream, in bins that start with their scenario."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowscope.functions import relative_bin, without_nan
from flowscope.sources.ledger import KeptTable

#: bins in one bucket of the kept table
BINS_TOGETHER = 64


class PortRates:
    """Distinct ports of each scenario and bin, kept as a table over micro-batches.

    A bin's ports are one row of at most 65,536 numbers. Bins start at the scenario's origin:
    its recorded start as ``read_timing`` gives it when the scenario is first seen, else
    its first event then; a later one does not move bins that are there. The watermark is the
    newest event time less ``late``. Rows of a bin that ended at or before it are left out and
    counted, as is done by windowed aggregation; rows without scenario or time have no bin.
    """

    def __init__(self, spark: SparkSession, path: str, width: float = 2, late_seconds: float = 60):
        self.width, self.late = float(width), float(late_seconds)
        together = F.floor(F.col("time_bin") / F.lit(self.width * BINS_TOGETHER))
        self.table = KeptTable(
            spark, path, "scenario string, time_bin double, ports array<int>", ["scenario", "time_bin"], bucket=together)

    def rates(self) -> DataFrame:
        """(scenario, time_bin, ports_per_sec) of all bins so far."""
        return self.table.read().select(
            "scenario", "time_bin", (F.size("ports") / F.lit(self.width)).alias("ports_per_sec"))

    def late_rows(self) -> int:
        return int(self.table.ledger.current().notes.get("late_rows", 0))

    def update(self, metrics: DataFrame, timing: DataFrame, batch_id: int) -> bool:
        """Add the rows of a micro-batch; False if it was in before."""
        state = self.table.ledger.current()
        if batch_id <= state.batch_id:
            return False
        origins = json.loads(state.notes.get("origins", "{}"))
        watermark = float(state.notes.get("watermark", "-inf"))
        rows = metrics.select("scenario", without_nan("timestamp").alias("t"), "dst_port").filter(
            F.col("scenario").isNotNull() & F.col("t").isNotNull()).persist()
        try:
            # one row per scenario
            ends = rows.groupBy("scenario").agg(F.min("t").alias("first"), F.max("t").alias("last")).collect()
            starts = {
                r["scenario"]: r["start"] for r in timing.groupBy("scenario")
                .agg(F.min("scenario_start_time").alias("start")).collect()}
            for r in ends:
                start = starts.get(r["scenario"])
                origins.setdefault(r["scenario"], r["first"] if start is None else start)
            binned = self._binned(rows, origins)
            late = (F.col("time_bin") + F.col("origin") + F.lit(self.width)) <= F.lit(watermark)
            n_late = binned.filter(late).count() if watermark > float("-inf") else 0
            in_time = binned.filter(~late).groupBy("scenario", "time_bin").agg(
                F.sort_array(F.collect_set("dst_port")).alias("ports"))
            newest = max([watermark, *[r["last"] - self.late for r in ends]])
            notes = {
                "origins": json.dumps(origins), "watermark": repr(newest),
                "late_rows": str(int(state.notes.get("late_rows", 0)) + n_late)}
            return self.table.upsert(in_time, batch_id, self._united, notes)
        finally:
            rows.unpersist()

    def _binned(self, rows: DataFrame, origins: dict[str, float]) -> DataFrame:
        known = rows.sparkSession.createDataFrame(sorted(origins.items()), "scenario string, origin double")
        return rows.join(known, "scenario").withColumn(
            "time_bin", relative_bin(F.col("t") - F.col("origin"), self.width))

    @staticmethod
    def _united(rows: DataFrame) -> DataFrame:
        """One row per bin with the ports of all its rows; an empty set has no port to explode."""
        ports = F.explode_outer("ports").alias("port")
        return rows.select("scenario", "time_bin", ports).groupBy("scenario", "time_bin").agg(
            F.sort_array(F.collect_set("port")).alias("ports"))


def stream_unique_port_rate(
    metrics: DataFrame, read_timing: Callable[[], DataFrame], rates: PortRates, checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Streaming form of ``unique_port_rate`` for all scenarios; results are in ``rates``.

    The timing table is read again for every micro-batch, so scenarios may start meanwhile.
    """
    return (
        metrics.writeStream.foreachBatch(lambda rows, i: rates.update(rows, read_timing(), i) and None)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
