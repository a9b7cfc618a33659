"""Size checks for the small side of a join, and intermediate data in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SMALL_ROWS = 100_000
SMALL_BYTES = 64 << 20
SETTING = "spark.checkpoint.dir"
#: rows of a table that one task keeps for several passes; a trainer's form of them is larger
ROWS_PER_TASK = 250_000


def small_rows(df: DataFrame, max_rows: int = SMALL_ROWS) -> pa.Table | None:
    """The whole of ``df`` when it has at most ``max_rows`` rows of ``SMALL_BYTES``, else None.

    At most ``max_rows + 1`` rows reach the driver, whatever the size of ``df``.
    """
    head = df.limit(max_rows + 1).toArrow()
    return head if head.num_rows <= max_rows and head.nbytes <= SMALL_BYTES else None


def small_or_same(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` as a local relation if it proves small, else ``df`` unchanged.

    Spark knows the exact size of a local relation, so it broadcasts it under
    ``spark.sql.autoBroadcastJoinThreshold`` without a hint, and the other side of the
    join is not shuffled. A larger ``df`` takes the ordinary shuffled join.
    """
    head = small_rows(df, max_rows)
    if head is None:
        return df
    return df.sparkSession.createDataFrame(head, schema=df.schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, as the session names it.

    Raises where ``spark.checkpoint.dir`` is unset: a folder chosen here would be local to
    each machine, and reading back would miss what the others wrote.
    """
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not base:
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    return base.rstrip("/")


def local_scratch(spark: SparkSession) -> None:
    """For the entry points of tests: a temporary folder, where all runs on one machine.

    Does nothing where the folder is set, or where the master is not this process.
    """
    master = spark.sparkContext.master
    unset = not (spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING))
    if unset and (master == "local" or master.startswith("local[")):
        spark.conf.set(SETTING, tempfile.mkdtemp(prefix="flowscope-"))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the shared folder; whoever asks for it owns what is written."""
    return f"{shared_dir(spark)}/flowscope-{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of up to ``rows`` rows, in parts of ``ROWS_PER_TASK`` at most where that takes more tasks than there are.

    Spark sizes the parts of a shuffle by their bytes there, where repeated values hardly count.
    """
    parts = -(-rows // ROWS_PER_TASK)
    return df.repartition(parts) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with its lineage cut.

    Several passes may read it, and a lost executor costs no recomputation. The files belong
    to the returned frame: with ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark
    removes them once nothing refers to it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
