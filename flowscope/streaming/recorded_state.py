"""The stateful processor of differencing under a recording switch; sent to the workers by value."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: stands for a null among whole numbers; the smallest value of a bigint
MISSING = -(2**63)
SWITCH, POLL = 0, 1


class RecordedSamples(StatefulProcessor):
    """Adds ``prev_<c>`` to the polls of many flows while recording is on.

    State are the switch, the newest sample of every flow since it was last turned, and rows
    that the watermark has not passed. Those it has passed are taken in the order of time,
    switch before polls, and ``seq``. A turn of the switch clears the samples of all flows.
    """

    def __init__(self, row: T.StructType, sample: T.StructType, out: list[str]):
        self._row, self._sample, self._out = row, sample, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        flow = T.StructType([T.StructField("flow", T.StringType())])
        self._newest = handle.getMapState("newest", flow, self._sample)
        self._switch = handle.getValueState("switch", T.StructType([T.StructField("on", T.IntegerType())]))
        self._waiting = handle.getListState("waiting", self._row)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, first = self._row.fieldNames(), None
        for frame in rows:
            self._waiting.appendList([*frame[names].astype(object).itertuples(index=False, name=None)])
            first = int(frame["us"].min()) if first is None else min(first, int(frame["us"].min()))
        self._handle.registerTimer(first // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = pd.DataFrame(self._waiting.get(), columns=self._row.fieldNames())
        due = (rows["us"] <= timerValues.getCurrentWatermarkInMs() * 1000).to_numpy()
        if not due.any():
            return
        later = rows[~due]
        if len(later):
            self._waiting.put([*later.astype(object).itertuples(index=False, name=None)])
            self._handle.registerTimer(int(later["us"].min()) // 1000 + 1)
        else:
            self._waiting.clear()
        polls = self._differenced(rows[due].sort_values(["us", "kind", "seq"], kind="stable"))
        if len(polls):
            yield polls[self._out]

    def _differenced(self, rows: pd.DataFrame) -> pd.DataFrame:
        before = self._switch.get()[0] if self._switch.exists() else 0
        turned_to = rows["on"].where(rows["kind"] == SWITCH).astype(float)
        on = turned_to.ffill().fillna(before).astype(int)
        turns = (on != on.shift(1, fill_value=before)).cumsum()
        names = self._sample.fieldNames()
        polls = rows.assign(turn=turns)[(rows["kind"] == POLL) & (on == 1)]
        polls = polls.astype({c: np.int64 for c in names})
        # a shift that fills with a whole number keeps whole numbers
        shifted = polls.groupby(["turn", "flow"], sort=False)[names].shift(1, fill_value=MISSING)
        polls = polls.assign(**{f"prev_{c}": shifted[c] for c in names})
        fresh = polls[polls["turn"] == 0].drop_duplicates("flow")
        for at, flow in zip(fresh.index, fresh["flow"]):
            if self._newest.containsKey((flow,)):
                for c, value in zip(names, self._newest.getValue((flow,))):
                    polls.at[at, f"prev_{c}"] = value
        if len(rows) and turns.iloc[-1] > 0:
            self._newest.clear()
        for row in polls[polls["turn"] == turns.iloc[-1]].drop_duplicates("flow", keep="last").itertuples():
            self._newest.updateValue((row.flow,), tuple(int(getattr(row, c)) for c in names))
        self._switch.update((int(on.iloc[-1]),))
        return polls

    def close(self) -> None:
        pass


cloudpickle.register_pickle_by_value(sys.modules[__name__])
