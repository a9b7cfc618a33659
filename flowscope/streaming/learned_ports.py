"""The stateful processor of forwarding decisions; sent to the workers by value."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: stands for a null among whole numbers; the smallest value of a bigint
MISSING = -(2**63)
LESSON = 0
#: rows in a block of the state that is written anew
ROWS_IN_BLOCK = 10_000


class LearnedPorts(StatefulProcessor):
    """Answers questions about addresses from the lessons before them, in event time.

    A group holds many addresses. Lessons (``kind`` 0) and questions wait in the state until the
    watermark has passed them, as blocks of the size in which they came, so that a row costs no
    call of its own. Then no earlier row can come any more, and what is due is taken for each
    address in the order of time, ``seq`` and kind: a question gets the newest port taught so
    far. The state has one port per device and address.
    """

    def __init__(self, row: T.StructType, out: list[str]):
        self._row = row
        self._out = out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        address = T.StructType([T.StructField("dpid", T.LongType()), T.StructField("mac", T.StringType())])
        self._ports = handle.getMapState("ports", address, T.StructType([T.StructField("port", T.LongType())]))
        self._waiting = handle.getListState("blocks", T.StructType([T.StructField("rows", T.BinaryType())]))
        kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
        self._block = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in self._row])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            self._waiting.appendValue((self._packed(frame),))
            first = int(frame["us"].min()) if first is None else min(first, int(frame["us"].min()))
        self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        blocks = [pa.ipc.open_stream(b[0]).read_all() for b in self._waiting.get()]
        if not blocks:
            return
        rows = pa.concat_tables(blocks).to_pandas()
        due = (rows["us"] <= timerValues.getCurrentWatermarkInMs() * 1000).to_numpy()
        if not due.any():
            return
        later = rows[~due]
        if len(later):
            parts = [later[i:i + ROWS_IN_BLOCK] for i in range(0, len(later), ROWS_IN_BLOCK)]
            self._waiting.put([(self._packed(part),) for part in parts])
            self._wake(int(later["us"].min()))
        else:
            self._waiting.clear()
        yield self._answered(rows[due])

    def _packed(self, rows: pd.DataFrame) -> bytes:
        table = pa.Table.from_pandas(rows[self._block.names], schema=self._block, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self._block) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    def _answered(self, rows: pd.DataFrame) -> pd.DataFrame:
        address = rows.groupby(["dpid", "mac"], sort=False).ngroup()
        rows = rows.assign(address=address).sort_values(["address", "us", "seq", "kind"], kind="stable")
        address, place = rows["address"].to_numpy(), np.arange(len(rows))
        ports = rows["port"].to_numpy(np.int64)
        lesson = rows["kind"].to_numpy() == LESSON
        teaches = lesson & (ports != MISSING)
        newest = np.maximum.accumulate(np.where(teaches, place, -1))
        begins = np.searchsorted(address, address)
        learned = np.where(newest >= begins, ports[newest], MISSING)
        # what was taught before is asked for once per address, and only where it counts
        open_ = np.flatnonzero(~lesson & (newest < begins))
        if len(open_):
            known = np.full(address[-1] + 1, MISSING, np.int64)
            for i in open_[np.unique(address[open_], return_index=True)[1]]:
                found = self._ports.getValue((int(rows["dpid"].iat[i]), rows["mac"].iat[i]))
                known[address[i]] = MISSING if found is None else found[0]
            learned[open_] = known[address[open_]]
        ends = np.append(np.flatnonzero(np.diff(address)), len(rows) - 1)
        for i in ends[newest[ends] >= begins[ends]]:
            self._ports.updateValue((int(rows["dpid"].iat[i]), rows["mac"].iat[i]), (int(learned[i]),))
        return rows[~lesson].assign(learned=learned[~lesson])[self._out]

    def _wake(self, us: int) -> None:
        """At the first watermark after this time; timers count milliseconds."""
        self._handle.registerTimer(us // 1000 + 1)

    def close(self) -> None:
        pass


cloudpickle.register_pickle_by_value(sys.modules[__name__])
