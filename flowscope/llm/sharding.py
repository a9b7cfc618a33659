"""Contiguous shards of nearly equal bytes, by global prefix sums.

Rows are range-partitioned by id. Every partition reports one row, its total bytes and
rows; the running sums of these totals are the offsets of the partitions, and a window in
each partition adds the offset of the row. A row belongs to the shard in whose share of all
bytes it begins, so a shard is at most one row longer than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.sizing import stored

#: bytes of a row beside its text
ROW_BYTES = 8


def row_size(text: Column | str) -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed part."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("long")


def balanced_shards(rows: DataFrame, key: str, size: str, shards: int) -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (from 0 without gaps in each shard).

    Shards follow the order of ``key`` (nulls first); rows of equal key, also whole repeated
    rows, follow the order in which they are read. ``size`` must be positive and not null.
    Columns of ``rows`` named ``shard`` or ``slot`` are replaced; an empty table stays empty.

    Ship no wide columns through here: both shuffles carry every column of ``rows``. The
    order of reading is part of the range key, so that one key that fills a third of the
    table is split as well.
    """
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    ranged = stored(
        rows.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias("__nth"))
        .repartitionByRange(partitions, F.col(key).asc_nulls_first(), "__nth")
        .withColumn("__slice", F.spark_partition_id()))
    totals = ranged.groupBy("__slice").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    before = W.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "__slice",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("__bytes"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__rows"),
        F.sum("bytes").over(W.partitionBy()).alias("__all"))
    inside = W.partitionBy("__slice").orderBy(F.col(key).asc_nulls_first(), "__nth")
    placed = (
        ranged.withColumns({
            "__begin": F.sum(size).over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col(size),
            "__row": F.row_number().over(inside) - 1})
        .join(F.broadcast(offsets), "__slice")  # one row for each partition of the shuffle
        .withColumns({
            # decimals: the product may pass 2^63 on very large tables
            "shard": F.expr(f"cast((cast(__bytes + __begin as decimal(38, 0)) * {shards}) div __all as int)"),
            "__row": F.col("__rows") + F.col("__row")}))
    first = placed.groupBy("shard").agg(F.min("__row").alias("__first"))
    return placed.join(F.broadcast(first), "shard").select(  # at most ``shards`` rows
        *[F.col(f"`{c}`") for c in kept], "shard", (F.col("__row") - F.col("__first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, ``size``, ``text_crc32``, ``shard`` and ``slot``."""
    rows = docs.select(
        F.col(key), row_size(F.col(text)).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0).cast("long")).alias("text_crc32"))
    return balanced_shards(rows, key, "size", shards)
