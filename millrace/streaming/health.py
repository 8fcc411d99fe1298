"""Health and latency of a running stream, from its progress."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class SourceState:
    """What the processor and the source are doing now; times are seconds of ``clock``.

    ``received`` starts a batch and ``finished`` ends it, ``heard`` notes that the source is alive without data, and ``observed`` tells
    how old a batch's earliest row was when the batch was received.
    """

    clock: Callable[[], float] = time.time
    connected: bool = True
    _since: float | None = None
    _busy: bool = False
    _received: float | None = None
    _lag: float | None = None
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def __post_init__(self):
        self._since = self.clock()

    def received(self) -> None:
        with self._lock:
            self._busy, self._since = True, self.clock()
            self._received = self._since

    def finished(self) -> None:
        with self._lock:
            self._busy, self._since = False, self.clock()

    def observed(self, earliest: float) -> None:
        """The earliest source timestamp of the last batch that was received, once its rows have been read."""
        with self._lock:
            self._lag = max(0.0, (self._received if self._received is not None else self.clock()) - earliest)

    def heard(self) -> None:
        with self._lock:
            if not self._busy:
                self._since = self.clock()

    def latency(self) -> float | None:
        """Seconds that the batch which is out has been out, and its rows were old by what was observed last; None if no batch is out."""
        with self._lock:
            return self.clock() - self._since + (self._lag or 0.0) if self._busy else None

    def unhealthy(self, max_latency: float) -> str | None:
        """Why the stream is not healthy, or None. Exactly the limit is healthy."""
        with self._lock:
            waited = self.clock() - self._since
            if not self.connected:
                return "no connection to the source"
            if waited <= max_latency:
                return None
            return "the processor is taking too long with a batch" if self._busy else "the source has delivered nothing for too long"
