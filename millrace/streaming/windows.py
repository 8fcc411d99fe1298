"""Arrival-time windows of a live stream that grow from a first length, as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import first_window_ms, random_scaling, window_lengths

OUTPUT = "key string, window_no long, opened_ms long, length_ms long, n long, weight long, boundary string, reason string"
_STATE = "window_no long, level int, opened_ms long, n long, weight long, boundary string"


class _Windows(StatefulProcessor):
    """State of a key: the number, level and opening of its window, and what is in it; without rows the window is still to open."""

    def __init__(self, lengths: tuple[int, ...]):
        self.lengths = lengths

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", _STATE)

    def _out(self, key, window: tuple, reason: str) -> pd.DataFrame:
        number, level, opened, n, weight, boundary = window
        return pd.DataFrame({"key": [key[0]], "window_no": [number], "opened_ms": [opened], "length_ms": [self.lengths[level]], "n": [n], "weight": [weight], "boundary": [boundary], "reason": [reason]})

    def _closed(self, window: tuple, boundary: str | None, restart: bool) -> tuple:
        """The window after one that ended; it opens with its first row."""
        level = 0 if restart else min(window[1] + 1, len(self.lengths) - 1)
        return window[0] + 1, level, 0, 0, 0, boundary

    def _no_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        found = pd.concat(list(rows)).sort_values("order", kind="stable")
        window = tuple(self.window.get()) if self.window.exists() else None
        before = window
        for weight, boundary in zip(found["weight"].tolist(), found["boundary"].tolist()):
            if window is None:
                window = (0, 0, 0, 0, 0, boundary)
            if boundary != window[5]:
                if window[3]:
                    yield self._out(key, window, "boundary")
                    window = self._closed(window, boundary, True)
                window = (window[0], 0, 0, 0, 0, boundary)
            elif window[3] and now >= window[2] + self.lengths[window[1]]:
                # these rows came before the timer's turn
                yield self._out(key, window, "end")
                window = self._closed(window, boundary, False)
            number, level, opened, n, total, _ = window
            window = (number, level, opened if n else now, n + 1, total + int(weight or 0), boundary)
        self.window.update(window)
        if before is None or not before[3] or (before[0], before[2]) != (window[0], window[2]):
            self._no_timers()
            self.handle.registerTimer(window[2] + self.lengths[window[1]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        window = tuple(self.window.get()) if self.window.exists() else None
        # a timer may fire after its window has gone
        if window and window[3] and timerValues.getCurrentProcessingTimeInMs() >= window[2] + self.lengths[window[1]]:
            self.window.update(self._closed(window, window[5], False))
            yield self._out(key, window, "end")

    def close(self) -> None:
        pass


def timed_windows_stream(df: DataFrame, duration_ms: int, first_scaling: float | None = None) -> DataFrame:
    """A row a window of a stream with columns key, order, weight and boundary.

    A key's first window opens with its first row and lasts ``duration_ms * first_scaling`` of processing time (None: a random share from a
    quarter to a half), each later one opens with its first row and lasts twice as long, ``duration_ms`` at most. Another ``boundary`` (null is
    one) ends the window and begins anew with the first length. State is a few numbers a key. Needs the RocksDB state store.
    """
    scaling = random_scaling() if first_scaling is None else first_scaling
    lengths = window_lengths(duration_ms, first_window_ms(duration_ms, scaling))
    grouped = df.select("key", "order", "weight", "boundary").groupBy("key")
    return grouped.transformWithStateInPandas(_Windows(lengths), OUTPUT, "append", "processingTime")
