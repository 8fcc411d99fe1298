"""Greedy batches with a timeout as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, n long, weight long, items array<string>, reason string"


class _Batches(StatefulProcessor):
    """Pending items of a key; a timer runs from the moment a batch becomes pending."""

    def __init__(self, max_weight: int, max_delay_ms: int):
        self.max_weight, self.max_delay_ms = max_weight, max_delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "items array<string>, weight long")

    def _out(self, key, items, weight, reason) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "n": [len(items)], "weight": [weight], "items": [items], "reason": [reason]})

    def _no_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        items, weight = (list(self.pending.get()[0]), self.pending.get()[1]) if self.pending.exists() else ([], 0)
        opened = not items
        found = pd.concat(list(rows)).sort_values("order", kind="stable")
        for item, w in zip(found["item"].tolist(), found["weight"].tolist()):
            if w >= self.max_weight or items and weight + w > self.max_weight:
                if items:
                    yield self._out(key, items, weight, "full")
                items, weight, opened = [], 0, True
            if w >= self.max_weight:
                yield self._out(key, [item], w, "full")
                continue
            items, weight = [*items, item], weight + w
            if weight == self.max_weight:
                yield self._out(key, items, weight, "full")
                items, weight, opened = [], 0, True
        if not items:
            self.pending.clear()
            self._no_timers()
            return
        self.pending.update((items, int(weight)))
        if opened:
            self._no_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.max_delay_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer may fire after its batch has gone
        if self.pending.exists():
            items, weight = self.pending.get()
            self.pending.clear()
            yield self._out(key, list(items), weight, "delay")

    def close(self) -> None:
        pass


def batch_up_stream(df: DataFrame, max_weight: int, max_delay_ms: int) -> DataFrame:
    """Batches of a stream with columns key, order, item (strings but ``order``) and weight (long).

    A key's batch is given out when it is full, or ``max_delay_ms`` of processing time after it was
    opened. Its state is at most ``max_weight`` heavy. Needs the RocksDB state store.
    """
    grouped = df.select("key", "order", "item", "weight").groupBy("key")
    return grouped.transformWithStateInPandas(_Batches(max_weight, max_delay_ms), OUTPUT, "append", "processingTime")
