"""The stateful processor; sent to the workers by value, so they need not have the package."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


#: stands for a null among whole numbers and times; the smallest value of a bigint
MISSING = -(2**63)
#: the key of a sample as text, and when its state was renewed; workers rename columns with an underscore in front
FLOW, SEEN = "sample_key", "sample_seen"
#: the group of a key, and its rows in one block of bytes
BUCKET, BLOCK = "sample_bucket", "sample_block"
#: rows that a task deals to groups at once
ROWS_AT_ONCE = 1 << 18


def blocks(schema: pa.Schema) -> Callable:
    """Rows with ``BUCKET`` to one row for each group, with its rows as one block.

    The worker of a stateful processor takes rows one by one as Python tuples; a block is one.
    """

    def dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        bucket = table[BUCKET].to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        rows = table.select(schema.names).cast(schema).take(pa.array(order)).combine_chunks()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        whole = rows.to_batches()[0]
        packed = [whole.slice(i, j - i).serialize().to_pybytes() for i, j in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[cuts[:-1]]), pa.array(packed, pa.binary())], names=[BUCKET, BLOCK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= ROWS_AT_ONCE:
                yield dealt(held)
                held, n = [], 0
        if held:
            yield dealt(held)

    return run


class PreviousSamples(StatefulProcessor):
    """Adds ``prev_<c>`` to each sample of many keys; state are the newest samples.

    Rows arrive in ``blocks``, times and whole numbers as bigint without nulls, the key as text
    in ``FLOW``. A sample older than the state of its key, by time and then by tiebreak, is ignored. State
    that is not renewed within the time to live, if there is one, is dropped. The state of
    all keys of a group is one block, so that a micro-batch reads and writes it once.
    """

    def __init__(
        self, rows: pa.Schema, order: list[str], carried: T.StructType, out: list[str], ttl_ms: int | None
    ):
        self._rows = rows
        self._order = order
        self._names = carried.fieldNames()
        self._out = out
        self._ttl_ms = ttl_ms
        held = [T.StructField(FLOW, T.StringType()), T.StructField(SEEN, T.LongType())]
        self._schema = to_arrow_schema(T.StructType([*held, *carried.fields]))

    def init(self, handle: StatefulProcessorHandle) -> None:
        block = T.StructType([T.StructField("block", T.BinaryType())])
        self._newest = handle.getValueState("newest", block, self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packed = [pa.ipc.read_record_batch(pa.py_buffer(b), self._rows) for frame in rows for b in frame[BLOCK]]
        batch = pa.Table.from_batches(packed).to_pandas(maps_as_pydicts="strict")
        now = 0 if self._ttl_ms is None else timerValues.getCurrentProcessingTimeInMs()
        state = self._read(now)
        codes, flows = pd.factorize(batch[FLOW])
        batch, codes = self._sorted(batch, codes)
        # the row of the state that belongs to each sample, -1 where there is none
        place = pd.Index(state[FLOW]).get_indexer(flows)[codes]
        kept = self._not_older(batch, state, place)
        if not kept.all():
            batch, codes, place = batch[kept].reset_index(drop=True), codes[kept], place[kept]
        if not len(batch):
            return
        first = np.append(True, codes[1:] != codes[:-1])
        last = np.append(first[1:], True)
        newest = batch.loc[last, [FLOW, *self._names]].assign(**{SEEN: now})
        stays = np.ones(len(state), bool)
        stays[place[place >= 0]] = False
        self._write([state[stays], newest] if stays.any() else [newest])
        before = {f"prev_{c}": _shifted(batch[c], first, state[c], place) for c in self._names}
        yield batch.assign(**before)[self._out]

    def _sorted(self, batch: pd.DataFrame, codes: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
        """By key, time and tiebreak; nulls come first, rows that equal in these stay in order."""
        columns = [batch[c] for c in self._order]
        if not all(pd.api.types.is_integer_dtype(c) for c in columns):
            columns = [c.rank(method="dense", na_option="top") for c in columns]
        order = np.lexsort([*[c.to_numpy() for c in reversed(columns)], codes])
        return batch.iloc[order].reset_index(drop=True), codes[order]

    def _read(self, now: int) -> pd.DataFrame:
        if not self._newest.exists():
            return self._schema.empty_table().to_pandas()
        state = pa.ipc.open_stream(self._newest.get()[0]).read_pandas()
        if self._ttl_ms is not None:
            state = state[state[SEEN] + self._ttl_ms > now].reset_index(drop=True)
        return state

    def _write(self, parts: list[pd.DataFrame]) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self._schema) as writer:
            for part in parts:
                writer.write_table(pa.Table.from_pandas(part, self._schema, preserve_index=False))
        self._newest.update((sink.getvalue().to_pybytes(),))

    def _not_older(self, batch: pd.DataFrame, state: pd.DataFrame, place: np.ndarray) -> np.ndarray:
        """Rows at or after the state of their key, by time and then by tiebreak; nulls come first."""
        known = np.flatnonzero(place >= 0)
        keep = np.ones(len(batch), bool)
        if not len(known):
            return keep
        ts = self._order[0]
        times, last = batch[ts].to_numpy()[known], state[ts].to_numpy()[place[known]]
        fits = times >= last
        for tie in self._order[1:]:
            ties, newest = batch[tie].to_numpy()[known], state[tie].to_numpy()[place[known]]
            there = pd.notna(newest)
            both = there & pd.notna(ties)
            later = np.zeros(len(known), bool)
            later[both] = (ties[both] >= newest[both]).astype(bool)
            fits &= ~there | (times > last) | later
        keep[known] = fits
        return keep

    def close(self) -> None:
        pass


def _shifted(column: pd.Series, first: np.ndarray, state: pd.Series, place: np.ndarray) -> pd.Series:
    """The column one row later, with the state in front of each key; whole numbers stay whole."""
    whole = pd.api.types.is_integer_dtype(column)
    moved = column.shift(1, fill_value=MISSING) if whole else column.shift(1)
    known = first & (place >= 0)
    moved[first] = MISSING if whole else None
    if known.any():
        moved[known] = state.to_numpy()[place[known]]
    return moved


cloudpickle.register_pickle_by_value(sys.modules[__name__])
