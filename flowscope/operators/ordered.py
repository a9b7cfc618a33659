"""Previous-row and latest-value lookups that survive hot keys.

A window over one key sorts all rows of that key in one task. Keys with more rows than a
chunk are found by counting; where there are none the plain window is left. The rows of hot
keys are cut by time, and by the tiebreak where one instant holds more than a chunk; the
window runs per (key, chunk), and the little that must cross a border is computed by a
pre-aggregated query and carried into the next chunk as an extra row. All other keys stay
whole.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowscope.functions import order_key
from flowscope.sizing import small_or_same

ROWS_PER_CHUNK = 20_000_000
MICROS = 1_000_000
GRIDS = [60 * MICROS, MICROS, MICROS // 1000]
#: rows looked at per chunk to choose borders; any borders give the same result
SAMPLES = 20
#: chunks that one instant may be cut into
ROOM = 1 << 20
#: chunks that all hot rows are cut into at most; their borders are known to the driver
MOST_CHUNKS = 4096


def time_cuts(df: DataFrame, ts: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> list[int]:
    """Chunk borders in epoch microseconds, about ``rows_per_chunk`` rows apart.

    Reads the time column only and counts rows per minute. Minutes with more rows than a
    chunk are counted again per second, and those per millisecond. What comes to the driver
    is one number per ``rows_per_chunk`` rows.
    """
    rows = df.filter(F.col(ts).isNotNull()).select(F.unix_micros(ts).alias("us"))
    cuts: set[int] = set()
    for width in GRIDS:
        cell = F.floor(F.col("us") / F.lit(width))
        grid = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
        in_order = W.orderBy("cell")
        chunk = F.floor((F.sum("n").over(in_order) - F.col("n")) / F.lit(rows_per_chunk))
        picked = (
            grid.withColumn("chunk", chunk)
            .withColumn("opens", F.col("chunk") > F.lag("chunk").over(in_order))
            .withColumn("crowded", F.col("n") > rows_per_chunk)
            .filter("opens OR crowded")
            .collect()
        )
        cuts.update(r["cell"] * width for r in picked if r["opens"])
        crowded = [r["cell"] for r in picked if r["crowded"]]
        if not crowded:
            break
        rows = rows.filter(cell.isin(crowded))
    return sorted(cuts)


def newest_first(df: DataFrame, ts: str, tiebreak: str | None) -> Column:
    """Orders the rows of ``df`` as a window over (ts, tiebreak) does, for any tiebreak type."""
    whole = ("tinyint", "smallint", "int", "bigint")
    if tiebreak is None or df.schema[tiebreak].dataType.simpleString() in whole:
        return order_key(ts, tiebreak)
    return F.when(F.col(ts).isNotNull(), F.struct(ts, tiebreak))


def chunked(df: DataFrame, ts: str, cuts: list[int]) -> DataFrame:
    """Add ``_chunk``, the number of the time chunk of a row; rows without a time come last."""
    if not cuts:
        return df.withColumn("_chunk", F.col(ts).isNull().cast("int"))
    borders = [float("-inf"), *map(float, cuts), float("inf")]
    cutter = Bucketizer(
        splits=borders, inputCol="_us", outputCol="_chunk", handleInvalid="keep"
    )
    placed = cutter.transform(df.withColumn("_us", F.unix_micros(ts).cast("double"))).drop("_us")
    last = F.lit(float(len(cuts) + 1))
    return placed.withColumn("_chunk", F.coalesce("_chunk", last).cast("int"))


def hot_keys(df: DataFrame, keys: list[str], rows_per_chunk: int) -> DataFrame | None:
    """Keys with more rows than a chunk, and their counts; None where there are none.

    Counted by partial aggregation over the key columns alone. Few of them are a local
    relation; many stay where they are and are joined as any other table.
    """
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > F.lit(rows_per_chunk))
    found = small_or_same(counted)
    return None if found is not counted and found.isEmpty() else found


def order_cuts(
    rows: DataFrame, ts: str, tiebreak: str | None, total: int, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> list[tuple]:
    """Borders (epoch microseconds, tiebreak) about ``rows_per_chunk`` of ``total`` rows apart.

    Chosen from a sample, which decides about the balance only. Without a tiebreak rows of
    one instant stay together, as nothing orders them. There are at most ``MOST_CHUNKS``
    chunks, so what comes to the driver does not grow with ``total``.
    """
    wanted = min(max(total // rows_per_chunk, 1), MOST_CHUNKS)
    tie = F.lit(None).cast("int") if tiebreak is None else F.col(tiebreak)
    timed = rows.filter(F.col(ts).isNotNull()).select(F.unix_micros(ts).alias("us"), tie.alias("tie"))
    seen = timed.sample(min(1.0, SAMPLES * wanted / total), seed=0).collect()
    seen = sorted(map(tuple, seen), key=lambda r: (r[0], r[1] is not None, r[1]))
    chunks = min(wanted, len(seen))
    return sorted({seen[i * len(seen) // chunks] for i in range(1, chunks)}, key=lambda r: (r[0], r[1] is not None, r[1]))


def placed(df: DataFrame, ts: str, tiebreak: str | None, cuts: list[tuple]) -> DataFrame:
    """Add ``_chunk``, which rises with (ts, tiebreak) and differs on both sides of each border."""
    ties: dict[int, list] = {}
    for us, tie in cuts:
        ties.setdefault(us, []).append(tie)
    times = sorted(ties)
    crowded = {us: some for us, some in ties.items() if len(some) > 1}
    cutter = Bucketizer(
        splits=[float("-inf"), *map(float, times), float("inf")], inputCol="_us", outputCol="_cell",
        handleInvalid="keep")
    rows = cutter.transform(df.withColumn("_us", F.unix_micros(ts).cast("double")))
    # rows after a crowded instant come after all of its parts
    part = F.lit(ROOM - 1)
    if crowded:
        kind = df.schema[tiebreak].dataType.simpleString()
        borders = df.sparkSession.createDataFrame(
            [(float(us), some) for us, some in crowded.items()], f"_at double, _ties array<{kind}>")
        rows = rows.join(borders, F.col("_us") == F.col("_at"), "left")
        passed = F.size(F.filter("_ties", lambda t: F.coalesce(t <= F.col(tiebreak), t.isNull())))
        part = F.when(F.col("_at").isNotNull(), passed).otherwise(part)
    last = F.lit(len(times) + 1).cast("long") * F.lit(ROOM)
    chunk = F.when(F.col("_us").isNotNull(), F.col("_cell").cast("long") * F.lit(ROOM) + part).otherwise(last)
    return rows.withColumn("_chunk", chunk).select(*[F.col(f"`{c}`") for c in df.columns], "_chunk")


def _with_chunks(
    df: DataFrame, keys: list[str], ts: str, tiebreak: str | None, rows_per_chunk: int,
) -> DataFrame | None:
    """Rows with ``_hot`` and ``_chunk``, the same for all rows of other keys; None without hot keys."""
    hot = hot_keys(df, keys, rows_per_chunk)
    if hot is None:
        return None
    total = hot.agg(F.sum("_n")).first()[0]
    own = [f"_key{i}" for i in range(len(keys))]
    listed = hot.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own)], F.lit(True).alias("_hot"))
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(o)) for k, o in zip(keys, own)])
    marked = df.join(listed, same, "left").drop(*own).withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    cuts = order_cuts(marked.filter("_hot"), ts, tiebreak, total, rows_per_chunk)
    chunks = placed(marked, ts, tiebreak, cuts)
    return chunks.withColumn("_chunk", F.when(F.col("_hot"), F.col("_chunk")).otherwise(F.lit(-1).cast("long")))


def with_previous(
    df: DataFrame,
    keys: list[str],
    ts: str,
    values: list[str],
    tiebreak: str | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add ``prev_<v>`` for each of ``values``: its value in the row before, per key."""
    order = [ts] if tiebreak is None else [ts, tiebreak]

    def lagged(w) -> dict[str, Column]:
        return {f"prev_{v}": F.lag(v).over(w) for v in values}

    rows = _with_chunks(df, keys, ts, tiebreak, rows_per_chunk)
    if rows is None:
        return df.withColumns(lagged(W.partitionBy(*keys).orderBy(*order)))

    newest = newest_first(df, ts, tiebreak)
    carry = list(dict.fromkeys([*order, *values]))
    ends = rows.filter("_hot").groupBy(*keys, "_chunk").agg(*[F.max_by(c, newest).alias(c) for c in carry])
    following = F.lead("_chunk").over(W.partitionBy(*keys).orderBy("_chunk"))
    carried = (
        ends.withColumn("_chunk", following)
        .filter(F.col("_chunk").isNotNull())
        .withColumn("_carried", F.lit(True))
    )
    both = rows.drop("_hot").withColumn("_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    return (
        both.withColumns(lagged(W.partitionBy(*keys, "_chunk").orderBy(*order)))
        .filter(~F.col("_carried"))
        .drop("_carried", "_chunk")
    )


def with_latest(
    rows: DataFrame,
    keys: list[str],
    ts: str,
    order: list[str],
    value: str,
    newest: Column,
    out: str,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` at or before each row, per key.

    ``order`` sorts the rows of a key, by ``ts`` and a tiebreak first; ``newest`` is one
    number ordered the same way among the rows that have a value.
    """

    def latest(*by: str) -> Column:
        w = W.partitionBy(*by).orderBy(*order)
        return F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))

    parts = _with_chunks(rows, keys, ts, order[1], rows_per_chunk)
    if parts is None:
        return rows.withColumn(out, latest(*keys))

    known = F.when(F.col(value).isNotNull(), newest)
    ends = parts.filter("_hot").groupBy(*keys, "_chunk").agg(F.max_by(value, known).alias("_end"))
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        ends.withColumn(value, F.last("_end", ignorenulls=True).over(earlier))
        .drop("_end")
        .filter(F.col(value).isNotNull())
        .withColumn("_carried", F.lit(True))
    )
    # a carried row has no time of its own, and nulls sort first
    both = parts.drop("_hot").withColumn("_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    return (
        both.withColumn(out, latest(*keys, "_chunk"))
        .filter(~F.col("_carried"))
        .drop("_carried", "_chunk")
    )
