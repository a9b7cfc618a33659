"""Nearest neighbours by cosine, with multiprobe p-stable hashing.

Vectors are scaled to length 1, so that the nearest by cosine are the nearest by distance.
A table projects a vector on ``projections`` random normal directions (2-stable) and cuts
each projection into slots of equal width; the slots together name its bucket. A query
visits, in every table, its own bucket and those around it. A perturbed bucket differs by
one slot in some projections; its score is the sum of squared distances from the query to
the slot borders that have to be crossed, and a small score means a likely success. Buckets
are visited in order of score. Candidates of all visited buckets are merged and ranked by
the exact cosine.

Equal vectors are one entry that carries its smallest ids, as many as can ever be returned,
so copies neither crowd a bucket nor multiply a query. Buckets of the index are cut into
blocks of bounded size, and every block is searched by the queries that visit it. Queries
that find fewer than they asked for are then compared with all entries, block by block.

Vectors of different length are not compared: each length is a table of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.sizing import stored

TABLES = 10
PROJECTIONS = 5
#: slot width, in units of the spread of a projection
WIDTH = 1.5
PROBES = 32
#: vectors in one block of a bucket
BLOCK = 4_096
SEED = 20_240


class Hashes:
    """The random directions and offsets of all tables, equal wherever they are made."""

    def __init__(self, dimension: int, tables: int, projections: int, width: float):
        rng = np.random.default_rng(SEED)
        self.tables, self.projections = tables, projections
        # a unit vector's projection on a normal direction has a spread of 1
        self.directions = rng.normal(size=(dimension, tables * projections))
        self.width = width
        self.offsets = rng.uniform(0, width, tables * projections)

    def slots(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot numbers and the place inside the slot (0 to 1): row, table, projection."""
        x = (units @ self.directions + self.offsets) / self.width
        slot = np.floor(x)
        shape = (len(units), self.tables, self.projections)
        return slot.astype(np.int64).reshape(shape), (x - slot).reshape(shape)


def bucket_numbers(slots: np.ndarray) -> np.ndarray:
    """One number for the slots along the last axis; close slots never share one."""
    number = np.zeros(slots.shape[:-1], np.int64)
    for k in range(slots.shape[-1]):
        number = number * 1_024 + (slots[..., k] + 512) % 1_024
    return number


def perturbations(projections: int, most: int = 3) -> np.ndarray:
    """Every way to move at most ``most`` slots by one down or up, the unmoved one first."""
    rows = [np.zeros(projections, np.int64)]
    for n in range(1, min(most, projections) + 1):
        for where in combinations(range(projections), n):
            for moves in product((-1, 1), repeat=n):
                row = np.zeros(projections, np.int64)
                row[list(where)] = moves
                rows.append(row)
    return np.array(rows)


def probe_buckets(hashes: Hashes, units: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in order of estimated success, and their scores: row, table, probe."""
    slot, inside = hashes.slots(units)
    moves = perturbations(hashes.projections)
    cost = np.einsum("rtk,pk->rtp", inside ** 2, moves == -1) + np.einsum("rtk,pk->rtp", (1 - inside) ** 2, moves == 1)
    order = np.argsort(cost, axis=-1, kind="stable")[..., :probes]
    buckets = bucket_numbers(slot[:, :, None, :] + moves[order])
    return buckets, np.take_along_axis(cost, order, -1)


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """A matrix of vectors of one dimension, in double precision."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    rows = flat.astype(np.float64).reshape(len(vectors), -1)
    with np.errstate(over="ignore", under="ignore"):
        norms = np.linalg.norm(rows, axis=1)
    far = ~np.isfinite(norms) | (norms < 1e-150)  # their squares leave the range
    if far.any():
        rows[far] /= np.abs(rows[far]).max(axis=1)[:, None]
        norms[far] = np.linalg.norm(rows[far], axis=1)
    return rows / norms[:, None]


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that take part: no null, no zero, no null or non-finite component."""
    x = F.col("vector")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(
        F.col(key).alias("id"), F.col(vector).alias("vector"),
    ).filter(F.col("id").isNotNull() & x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0.0))


def _same_bits(vector: str, kind: str):
    """-0.0 equals 0.0, yet their bits differ."""
    return F.transform(vector, lambda x: F.when(x == 0.0, F.lit(0.0)).otherwise(x).cast(kind))


def distinct_vectors(rows: DataFrame, copies: int, kind: str) -> DataFrame:
    """One row for each different vector with its ``copies`` smallest ids.

    The ids of one vector are cut twice, first within slices of the table, so that a vector
    that fills a third of it does not meet in one task.
    """
    slices = F.pmod(F.xxhash64("id"), F.lit(64))
    plain = rows.withColumn("vector", _same_bits("vector", kind))
    first = W.partitionBy("vector", "slice").orderBy("id")
    cut = plain.withColumn("slice", slices).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= copies)
    return cut.groupBy("vector").agg(F.slice(F.array_sort(F.collect_list("id")), 1, copies).alias("ids"))


def _by_size(batches: Iterator[pa.RecordBatch], **how) -> Iterator[tuple[int, Hashes, pa.RecordBatch]]:
    """The rows of one vector length at a time, with the directions for it."""
    made: dict[int, Hashes] = {}
    for batch in batches:
        sizes = pc.list_value_length(batch.column("vector"))
        for n in pc.unique(sizes).to_pylist():
            if n not in made:
                made[n] = Hashes(n, **how)
            yield n, made[n], batch.filter(pc.equal(sizes, n))


def _index(**how) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, hashes, batch in _by_size(batches, **how):
            slot, _ = hashes.slots(unit_rows(batch.column("vector")))
            buckets = bucket_numbers(slot)
            for t in range(hashes.tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, n, np.int32)), pa.array(np.full(batch.num_rows, t, np.int32)),
                     pa.array(buckets[:, t]), batch.column("vector"), batch.column("ids")],
                    names=["size", "table", "bucket", "vector", "ids"])

    return run


def _probes(probes: int, **how) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, hashes, batch in _by_size(batches, **how):
            buckets, _ = probe_buckets(hashes, unit_rows(batch.column("vector")), probes)
            n = buckets.shape[-1]
            at = pa.array(np.repeat(np.arange(batch.num_rows), n))
            for t in range(hashes.tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), size, np.int32)), pa.array(np.full(len(at), t, np.int32)),
                     pa.array(buckets[:, t].ravel()),
                     batch.column("vector").take(at), batch.column("qid").take(at)],
                    names=["size", "table", "bucket", "vector", "qid"])

    return run


def _rank(nearest: int) -> Callable:
    """In one block of a bucket: the best entries of every query that visits it."""

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return _found([], [], [], [])
        entries = unit_rows(pa.array(index["vector"].tolist(), pa.list_(pa.float64())))
        asked = unit_rows(pa.array(queries["vector"].tolist(), pa.list_(pa.float64())))
        ids = index["ids"].tolist()
        firsts = np.array([x[0] for x in ids])
        found = []
        for i in range(0, len(asked), 512):
            scores = asked[i:i + 512] @ entries.T
            # every entry holds one id at least, one of which may be the query's own
            most = min(nearest + 1, scores.shape[1])
            least = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
            at, entry = np.nonzero(scores >= least[:, None] - 1e-12)
            found.append(_found(
                queries["qid"].to_numpy()[i + at], firsts[entry], scores[at, entry], [ids[e] for e in entry]))
        return pd.concat(found)

    return run


def _found(qid, vector_id, score, ids) -> pd.DataFrame:
    return pd.DataFrame({
        "qid": pd.Series(qid, dtype="int64"), "vector_id": pd.Series(vector_id, dtype="int64"),
        "score": pd.Series(score, dtype="float64"), "ids": pd.Series(ids, dtype=object)})


def _in_blocks(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """``rows`` with ``blocks``, the number of blocks of their bucket."""
    more = crowded.toDF("_size", "_table", "_bucket", "_blocks")
    here = (F.col("size") == F.col("_size")) & (F.col("table") == F.col("_table")) & (F.col("bucket") == F.col("_bucket"))
    return rows.join(more, here, "left").withColumn("blocks", F.coalesce("_blocks", F.lit(1).cast("long"))).drop(*more.columns)


FOUND = "qid long, vector_id long, score double, ids array<long>"


def _against_all(entries: DataFrame, asked: DataFrame, nearest: int) -> DataFrame:
    """Candidates of the rows ``asked`` among all ``entries`` of their length.

    Both sides are cut into blocks of about ``BLOCK`` rows, and every pair of blocks meets
    in a group of its own.
    """
    def numbered(rows: DataFrame, by: str, name: str) -> tuple[DataFrame, DataFrame]:
        sized = rows.withColumn("size", F.size("vector"))
        blocks = sized.groupBy("size").agg(F.ceil(F.count("*") / BLOCK).alias(f"{name}s"))
        return sized.join(blocks, "size").withColumn(name, F.pmod(F.xxhash64(by), F.col(f"{name}s"))), blocks

    def every(name: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{name}s") - 1)).alias(name)

    left, lefts = numbered(entries, "ids", "block")
    right, rights = numbered(asked, "qid", "part")
    left = left.drop("blocks").join(rights, "size").select("size", "block", "vector", "ids", every("part"))
    right = right.drop("parts").join(lefts, "size").select("size", "part", "vector", "qid", every("block"))
    cell = ["size", "block", "part"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(_rank(nearest), FOUND)


def search(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding",
    nearest: int = 5, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH,
    probes: int = PROBES,
) -> DataFrame:
    """The ``nearest`` rows of ``vectors`` found for each row of ``queries``.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, the cosine in double
    precision; ties go to the smaller id. A row is never its own neighbour: candidates have
    another ``key``. Vectors that are null, zero, or hold null or non-finite components take
    no part, nor do rows with a null key; of repeated keys each counts. A query is compared
    with vectors of its own length. It has fewer than ``nearest`` rows only where there are
    fewer candidates: then, and where its buckets hold too few, it is compared with all.
    """
    rows, asked = _usable(vectors, key, vector), _usable(queries, key, vector)
    kind = rows.schema["vector"].dataType.elementType.simpleString()
    kind = "float" if kind == "float" else "double"
    how = {"tables": tables, "projections": projections, "width": width}
    entries = distinct_vectors(rows, nearest + 1, kind)
    index = entries.mapInArrow(
        _index(**how), f"size int, table int, bucket long, vector array<{kind}>, ids array<long>")
    # one search for each different query vector, whose number is its smallest id
    probing = asked.withColumn("vector", _same_bits("vector", kind))
    groups = probing.groupBy("vector").agg(F.min("id").alias("qid"))
    visits = groups.mapInArrow(
        _probes(probes, **how), f"size int, table int, bucket long, vector array<{kind}>, qid long")
    crowded = (
        index.groupBy("size", "table", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
        .select("size", "table", "bucket", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    index = _in_blocks(index, crowded).withColumn(
        "block", F.pmod(F.xxhash64("ids"), F.col("blocks"))).select("size", "table", "bucket", "block", "vector", "ids")
    visits = _in_blocks(visits, crowded).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    ).select("size", "table", "bucket", "block", "vector", "qid")
    cell = ["size", "table", "bucket", "block"]
    candidates = index.groupBy(*cell).cogroup(visits.groupBy(*cell)).applyInPandas(_rank(nearest), FOUND)
    members = probing.select("vector", F.col("id").alias("query_id")).join(groups, "vector").select("qid", "query_id")
    # read for the result and for the queries that have too few
    best = stored(_best(candidates, nearest))
    others = _pairs(members, best).groupBy("qid", "query_id").agg(F.count("*").alias("n"))
    few = stored(
        members.distinct().join(others, ["qid", "query_id"], "left")
        .filter(F.coalesce("n", F.lit(0)) < nearest).select("qid").distinct())
    if not few.isEmpty():
        alone = _against_all(entries, groups.join(few, "qid"), nearest)
        best = _best(best.unionByName(alone), nearest)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return _pairs(members, best).withColumn("rank", rank).filter(
        F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def _best(candidates: DataFrame, nearest: int) -> DataFrame:
    """The best entries of each query; one that was found in several buckets counts once."""
    merged = candidates.groupBy("qid", "vector_id").agg(
        F.max("score").alias("score"), F.first("ids").alias("ids"))
    return merged.withColumn("nth", F.row_number().over(
        W.partitionBy("qid").orderBy(F.desc("score"), "vector_id"))).filter(F.col("nth") <= nearest + 1).drop("nth")


def _pairs(members: DataFrame, best: DataFrame) -> DataFrame:
    """Each query row with the rows found for its vector, without itself."""
    return (
        members.join(best, "qid")
        .select("qid", "query_id", "score", F.explode("ids").alias("vec_id"))
        .filter(F.col("query_id") != F.col("vec_id")))
