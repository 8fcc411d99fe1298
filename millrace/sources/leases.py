"""Keeping messages that are being processed: deadlines, parallel pulls, and commits that are tried again."""

from __future__ import annotations

import heapq
import math
import os
import threading
import time
from collections.abc import Callable, Iterable

from ..runtime.retry import full_jitter


class Keeper:
    """Extends the deadlines of ranges that were handed out until they are released, however long their processing takes.

    A heap orders the ranges by deadline, and a thread calls ``extend(shard, start, end)`` when less than ``min_remaining`` of a
    ``duration`` is left. An extension that fails is tried again at the next turn, as long as the range is held.
    """

    def __init__(self, extend: Callable[[str, int, int], None], duration: float, min_remaining: float = 0.25, clock: Callable[[], float] = time.monotonic):
        self.extend, self.duration, self.remaining, self.clock = extend, duration, min_remaining * duration, clock
        self._heap: list[tuple[float, str, int, int]] = []
        self._held: set[tuple[str, int, int]] = set()
        self._changed, self._closed = threading.Condition(), False
        self._thread: threading.Thread | None = None

    def hold(self, ranges: Iterable[tuple[str, int, int]]) -> None:
        with self._changed:
            for own in ranges:
                if own not in self._held:
                    self._held.add(own)
                    heapq.heappush(self._heap, (self.clock() + self.duration, *own))
            if self._thread is None:
                self._thread = threading.Thread(target=self._run, daemon=True)
                self._thread.start()
            self._changed.notify()

    def release(self, offsets: dict[str, int]) -> None:
        """Let go of all ranges that end at or before a shard's offset."""
        with self._changed:
            self._held = {r for r in self._held if r[2] > offsets.get(r[0], -1)}

    def due(self) -> list[tuple[str, int, int]]:
        """Take the ranges that are to be extended now off the heap; those that were released go."""
        out = []
        while self._heap and self._heap[0][0] - self.clock() <= self.remaining:
            _, *own = heapq.heappop(self._heap)
            if tuple(own) in self._held:
                out.append(tuple(own))
        return out

    def turn(self) -> None:
        """Extend what is due."""
        with self._changed:
            due = self.due()
        for own in due:
            began = self.clock()
            try:
                self.extend(*own)
                deadline = began + self.duration
            except Exception:
                deadline = began + min(self.duration, 2 * self.remaining)
            with self._changed:
                if own in self._held:
                    heapq.heappush(self._heap, (deadline, *own))

    def _run(self) -> None:
        while True:
            with self._changed:
                if self._closed:
                    return
                wait = self._heap[0][0] - self.remaining - self.clock() if self._heap else None
                if wait is None or wait > 0:
                    self._changed.wait(wait)
            self.turn()

    def close(self) -> None:
        with self._changed:
            self._closed = True
            self._changed.notify()


class Debounced:
    """Commits that come within ``delay`` seconds of the first pending one are one: per shard the largest offset.

    ``flush`` commits what is pending at once. An error is kept and raised by the next ``add`` or ``flush``; what was not
    committed stays pending.
    """

    def __init__(self, commit: Callable[[dict[str, int]], None], delay: float):
        self.commit, self.delay = commit, delay
        self.pending: dict[str, int] = {}
        #: offsets that need no commit, or none any more
        self.done: dict[str, int] = {}
        self._lock, self._error = threading.RLock(), None
        self._timer: threading.Timer | None = None

    def add(self, offsets: dict[str, int]) -> None:
        with self._lock:
            self._raise()
            for shard, n in offsets.items():
                if n > self.done.get(shard, -1):
                    self.pending[shard] = max(n, self.pending.get(shard, n))
            if self.delay <= 0:
                return self.flush()
            if self._timer is None and self.pending:
                self._timer = threading.Timer(self.delay, self._late)
                self._timer.daemon = True
                self._timer.start()

    def _late(self) -> None:
        try:
            self.flush()
        except Exception as error:
            with self._lock:
                self._error = error

    def flush(self) -> None:
        with self._lock:
            self._raise()
            if self._timer is not None:
                self._timer.cancel()
                self._timer = None
            if self.pending:
                self.commit(dict(self.pending))
                self.done |= self.pending
                self.pending = {}

    def _raise(self) -> None:
        error, self._error = self._error, None
        if error is not None:
            raise error


def parallel_pulls(factor: float, cores: int | None = None) -> int:
    return max(1, math.ceil((cores or os.cpu_count() or 1) * factor))


class Throttled(Exception):
    pass


class LeaseLost(Exception):
    """Another consumer has the shard by now; the commit is its business."""


def commit(action: Callable[[], None], delay: float, attempts: int, sleep: Callable[[float], None]) -> bool:
    """Commit with retries while the broker throttles; False if the lease was lost, other errors pass."""
    delays = full_jitter(delay)
    for k in range(attempts):
        try:
            action()
            return True
        except LeaseLost:
            return False
        except Throttled:
            if k + 1 == attempts:
                raise
            sleep(next(delays))
    return False
