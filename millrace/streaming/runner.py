"""Running an event processor over a stream, at least once.

A processor takes a micro-batch and its id. Its return is the acknowledgement: Spark commits the
batch's offsets after it, and a batch that raised is delivered again after a restart. With a gate, what it
returns is what the batch's last step needs, which runs later and in order.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.codec import Limits, decompress, with_batches
from .gate import CommitGate
from .health import SourceState

Processor = Callable[[DataFrame, int], dict | None]
#: Name of the metrics that are observed as a batch is read.
OBSERVED = "millrace_source"


@dataclass
class Stream:
    """A running query with health, latency and a stop that lets the batch in progress finish."""

    query: StreamingQuery
    state: SourceState
    _stopping: threading.Event
    _between: threading.Lock
    gate: CommitGate | None = None

    def stop(self, timeout: float | None = None) -> None:
        """Wait until no batch is being processed, then stop; no further batch is begun, and pending last steps are run."""
        self._stopping.set()
        got = self._between.acquire(timeout=-1 if timeout is None else timeout)
        try:
            self.query.stop()
        finally:
            if got:
                self._between.release()
            if self.gate:
                self.gate.drain()

    def unhealthy(self, max_latency: float) -> str | None:
        if not self.query.isActive:
            self.state.connected = False
        return self.state.unhealthy(max_latency)


class Stopping(RuntimeError):
    """Raised for a batch that arrives while the stream is stopping; its offsets stay uncommitted."""


def run(source: DataFrame, processor: Processor, checkpoint: str, source_ts: str | None = None, window: str | None = None, state: SourceState | None = None, available_now: bool = False, gate: CommitGate | None = None) -> Stream:
    """Start a processor on a streaming DataFrame.

    ``window`` (``"60 seconds"``) makes windows of processing time; without it batches follow each
    other. ``source_ts`` names the column whose minimum is the batch's earliest source timestamp: it is observed as the
    batch is read, in the processor's own jobs, and comes with the query's progress (see ``listener``). ``gate`` runs the last steps
    of batches: those left pending come first, and a batch that has a manifest is not processed again.
    """
    state = state or SourceState()
    stopping, between = threading.Event(), threading.Lock()
    if source_ts:
        source = source.observe(OBSERVED, F.min(F.unix_micros(F.col(source_ts).cast("timestamp"))).alias("earliest"))
    if gate:
        gate.recover()

    def one(batch: DataFrame, batch_id: int) -> None:
        with between:
            if stopping.is_set():
                raise Stopping("the stream is stopping")
            if gate and gate.seen(batch_id):
                return
            state.received()
            content = processor(batch, batch_id)
            if gate:
                gate.submit(batch_id, content)
            state.finished()

    writer = source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif window:
        writer = writer.trigger(processingTime=window)
    return Stream(writer.start(), state, stopping, between, gate)


def decompressing(processor: Callable[[DataFrame, int], None], limits: Limits, payload: str = "value") -> Processor:
    """A processor that hands on decompressed payloads and bad rows, with batch numbers, in place of messages."""

    def one(batch: DataFrame, batch_id: int) -> None:
        rows = decompress(batch.withColumn("ordinal", F.monotonically_increasing_id()), limits, payload).persist()
        try:
            processor(with_batches(rows, limits), batch_id)
        finally:
            rows.unpersist()

    return one
