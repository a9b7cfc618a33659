"""Rows on their way to Python workers and back."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_texts(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str | None]:
    """``docs`` as ``key`` and ``text``; where the text is a field of the key, as ``key`` and the field's name.

    A text that goes along in a whole row is thus not sent a second time.
    """
    inner = text.removeprefix(f"{key}.") if text.startswith(f"{key}.") else None
    if inner is not None:
        return docs.select(F.col(key).alias("key")), inner
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")), None


def text_column(batch: pa.RecordBatch, field: str | None) -> pa.Array:
    """The texts of a batch of ``keyed_texts``."""
    return batch.column("text") if field is None else pc.struct_field(batch.column("key"), field)


def whole_rows(docs: DataFrame) -> DataFrame:
    """One column ``row`` with all columns of ``docs``, whatever their names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
