"""Column and row selection, cleaning, duplicates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.functions import finite
from flowscope.schemas import DROP, METADATA


def traffic_columns(df: DataFrame, exclude: list[str] = METADATA) -> DataFrame:
    return df.drop(*exclude)


def for_scenario(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("scenario") == F.lit(name))


def drop_events(df: DataFrame) -> DataFrame:
    return df.filter(F.col("action_taken") == F.lit(DROP))


def _fractional(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def inf_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: finite(c) for c in _fractional(df)})


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without null or NaN in any column.

    One condition per column: ``na.drop`` puts all columns into a single one, and on a wide
    table the optimizer's constraint inference grows exponentially over it.
    """
    numbers = set(_fractional(df))
    present = [
        F.col(c).isNotNull() & ~F.isnan(c) if c in numbers else F.col(c).isNotNull()
        for c in df.columns
    ]
    return df.filter(reduce(and_, present))


def dedupe_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """One of each set of equal rows; copies collapse before the shuffle.

    A ``key`` is not compared.
    """
    return df.dropDuplicates([c for c in df.columns if c != key])


def clean(df: DataFrame, key: str | None = None) -> DataFrame:
    """Complete, finite, distinct rows; the filter runs below the shuffle.

    Same rows as ``inf_to_null``, ``complete_rows`` and ``dedupe_rows`` in turn: null, NaN
    and both infinities all fail the comparison.
    """
    numbers = set(_fractional(df))
    usable = [
        F.abs(c) < F.lit(float("inf")) if c in numbers else F.col(c).isNotNull()
        for c in df.columns
    ]
    return dedupe_rows(df.filter(reduce(and_, usable)), key)
