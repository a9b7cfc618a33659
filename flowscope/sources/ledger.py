"""Tables whose content is the folders that the newest ledger file names.

A change writes new folders first and the ledger file last, by a rename that fails where
the file is there already. So a reader sees a change as a whole or not at all, a writer that
ends half-way leaves nothing that counts, and a micro-batch that is run again changes
nothing. Folders are only ever added; ``vacuum`` removes what old ledger files named.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEPT_VERSIONS = 3


@dataclass(frozen=True)
class State:
    """What a ledger file says: its number, the newest micro-batch in it, folders and notes."""

    version: int = -1
    batch_id: int = -1
    folders: tuple[str, ...] = ()
    notes: dict[str, str] = field(default_factory=dict)


class ConflictError(RuntimeError):
    """Another writer has committed the same version."""


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = f"{self.path}/_ledger"

    def current(self) -> State:
        """The newest state; the first one of a new table names nothing."""
        schema = "version long, batch_id long, folders array<string>, notes map<string, string>"
        # a leading underscore hides the folder from readers of the table, so files are named
        names = [f"{self._files}/{n}" for n in self._listed()]
        if not names:
            return State()
        newest = self.spark.read.schema(schema).json(max(names)).first()
        return State(newest["version"], newest["batch_id"], tuple(newest["folders"]), dict(newest["notes"]))

    def commit(self, state: State) -> State:
        """Write the version after ``state.version``; raises where it is there already."""
        following = replace(state, version=state.version + 1)
        line = json.dumps({
            "version": following.version, "batch_id": following.batch_id,
            "folders": list(following.folders), "notes": following.notes})
        fs, hadoop = self._fs()
        draft = hadoop.Path(f"{self._files}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(line.encode()))
        out.close()
        final = hadoop.Path(f"{self._files}/{following.version:012d}.json")
        context = hadoop.FileContext.getFileContext(final.toUri(), self._conf())
        rename = getattr(hadoop, "Options$Rename")
        no_options = self.spark.sparkContext._gateway.new_array(rename, 0)
        try:
            context.rename(draft, final, no_options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise ConflictError(f"version {following.version} is there already") from e
            raise
        return following

    def read(self, schema: T.StructType, folders: tuple[str, ...] | None = None) -> DataFrame:
        """The rows of all folders of the newest state, or of those given."""
        names = self.current().folders if folders is None else folders
        if not names:
            return self.spark.createDataFrame([], schema)
        # below the table's path a folder of rows laid out by a column is itself a partition
        laid_out = any(n.startswith("folder=") for n in names)
        reader = self.spark.read.schema(schema)
        reader = reader.option("basePath", self.path) if laid_out else reader
        return reader.parquet(*[f"{self.path}/{n}" for n in names]).select(*schema.fieldNames())

    def vacuum(self, keep: int = KEPT_VERSIONS) -> None:
        """Remove old ledger files, and folders that none of the newest ``keep`` names.

        Call it from the writer only: a folder that is being written is in no ledger yet.
        """
        fs, hadoop = self._fs()
        versions = sorted(self._listed())
        schema = "folders array<string>"
        kept = versions[-keep:]
        if not kept:
            return
        named = {
            n for row in self.spark.read.schema(schema).json([f"{self._files}/{v}" for v in kept]).collect()
            for n in row["folders"]}
        for status in fs.listStatus(hadoop.Path(self.path)):
            name = status.getPath().getName()
            if status.isDirectory() and not name.startswith(("_", ".")):
                if not any(n == name or n.startswith(f"{name}/") for n in named):
                    fs.delete(status.getPath(), True)
        for old in versions[:-keep]:
            fs.delete(hadoop.Path(f"{self._files}/{old}"), False)

    def _listed(self) -> list[str]:
        fs, hadoop = self._fs()
        folder = hadoop.Path(self._files)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return [n for n in names if n.endswith(".json") and not n.startswith(".")]

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        return hadoop.Path(self.path).getFileSystem(self._conf()), hadoop


class KeptTable:
    """One row per key, replaced by the newest one that a micro-batch brings.

    Rows lie in buckets, and a micro-batch writes only the buckets it touches anew. The
    default spreads keys evenly; for keys that go with time give a ``bucket`` of time, so that
    old ones are left alone.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16,
        bucket: Column | None = None,
    ):
        self.ledger = Ledger(spark, path)
        self.keys = keys
        self.schema = T.StructType.fromDDL(schema)
        self._bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)) if bucket is None else bucket

    def read(self) -> DataFrame:
        return self.ledger.read(self.schema)

    def upsert(self, rows: DataFrame, batch_id: int, merge=None, notes: dict[str, str] | None = None) -> bool:
        """Put in the rows of a micro-batch, of which a key may have one; False if it was in before.

        ``merge`` makes one row per key of the old and new rows together; without it the new
        row stays. ``notes`` are kept with the version.
        """
        state = self.ledger.current()
        if batch_id <= state.batch_id:
            return False
        names = self.schema.fieldNames()
        new = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn(
            "_bucket", self._bucket.cast("long")).persist()
        try:
            touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
            folder = f"v{state.version + 1}-{uuid.uuid4().hex[:8]}"
            inside = {b: [n for n in state.folders if n.endswith(f"/_bucket={b}")] for b in touched}
            if touched:
                old = self.ledger.read(self.schema, tuple(n for some in inside.values() for n in some))
                old = old.withColumn("_bucket", self._bucket.cast("long"))
                if merge is None:
                    same = [old[k].eqNullSafe(new[k]) for k in self.keys]
                    every = old.join(new, same, "left_anti").unionByName(new)
                else:
                    every = merge(old.unionByName(new).select(*names)).withColumn("_bucket", self._bucket.cast("long"))
                # one file per bucket: buckets are small beside the table
                every.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.ledger.path}/{folder}")
            gone = {n for some in inside.values() for n in some}
            folders = tuple(n for n in state.folders if n not in gone) + tuple(
                f"{folder}/_bucket={b}" for b in touched)
            self.ledger.commit(State(state.version, batch_id, folders, state.notes | (notes or {})))
        finally:
            new.unpersist()
        return True


class RowLog:
    """Rows of micro-batches, each of them once, in folders that ``compact`` makes fewer.

    Folders are laid out by ``by``, so a reader of one value reads its part of each only.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: str):
        self.ledger = Ledger(spark, path)
        self.schema, self.by = schema, by

    def read(self) -> DataFrame:
        return self.ledger.read(self.schema)

    def append(self, rows: DataFrame, batch_id: int) -> bool:
        """Add a micro-batch; False, and nothing is done, if it is in already."""
        while True:
            state = self.ledger.current()
            if batch_id <= state.batch_id:
                return False
            folder = f"folder=b{batch_id}-{uuid.uuid4().hex[:8]}"
            rows.select(*self.schema.fieldNames()).write.partitionBy(self.by).parquet(f"{self.ledger.path}/{folder}")
            try:
                self.ledger.commit(State(state.version, batch_id, (*state.folders, folder), state.notes))
                return True
            except ConflictError:
                continue  # a compaction came first

    def compact(self, rows_per_file: int = 5_000_000, least: int = 2) -> int:
        """Write the folders of ``append`` anew as one; their number, 0 if fewer than ``least``.

        The rows stay readable from the old folders until the ledger names the new one. A
        folder that is itself the outcome of a compaction is left alone.
        """
        state = self.ledger.current()
        small = tuple(n for n in state.folders if n.startswith("folder=b"))
        if len(small) < least:
            return 0
        folder = f"folder=c{state.version + 1}-{uuid.uuid4().hex[:8]}"
        rows = self.ledger.read(self.schema, small)
        # large values are spread over several tasks, small ones share none of their files
        (
            rows.repartition(self.by, F.pmod(F.monotonically_increasing_id(), F.lit(self._spread(rows, rows_per_file))))
            .write.partitionBy(self.by).parquet(f"{self.ledger.path}/{folder}"))
        while True:
            now = self.ledger.current()
            left = tuple(n for n in now.folders if n not in small)
            try:
                self.ledger.commit(replace(now, folders=(*left, folder)))
                return len(small)
            except ConflictError:
                continue  # a micro-batch came first; its folder stays beside ours

    def _spread(self, rows: DataFrame, rows_per_file: int) -> int:
        largest = rows.groupBy(self.by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        return -(-(largest or 1) // rows_per_file)
