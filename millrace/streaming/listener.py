"""Feeds a source's state and metrics from Spark's own progress events."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener

from ..runtime.reporting import Metrics
from .health import SourceState
from .runner import OBSERVED


class ProgressListener(StreamingQueryListener):
    """An idle trigger is a sign of life; progress counts rows and tells a batch's latency; the end of a query is the end of its source.

    Register with ``spark.streams.addListener``. ``name`` limits it to one query.
    """

    def __init__(self, state: SourceState, metrics: Metrics | None = None, name: str | None = None):
        self.state, self.name = state, name
        metrics = metrics or Metrics()
        self.metrics = metrics
        self._rows = metrics.counter("rows")
        # of a batch that is out, if that is asked before its progress is known
        self._latency = metrics.timer("latency_ms", lambda: None if (s := state.latency()) is None else s * 1000)
        self._duration = metrics.gauge("batch_ms")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self.name in (None, event.progress.name):
            self.state.heard()
            self._rows(event.progress.numInputRows)
            self._duration(event.progress.batchDuration)
            # measured in the jobs that read the batch: no job of its own, and nothing is kept for it
            seen = event.progress.observedMetrics.get(OBSERVED)
            if seen is not None and seen["earliest"] is not None:
                earliest = seen["earliest"] / 1e6
                self.state.observed(earliest)
                self._latency(max(0, int(1000 * (self.state.clock() - earliest))))

    def onQueryIdle(self, event) -> None:
        self.state.heard()

    def onQueryTerminated(self, event) -> None:
        self.state.connected = False
