"""A resource that is open for one kind of use at a time and closed before it is opened again."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from typing import Generic, TypeVar

A = TypeVar("A")


class Coldswap(Generic[A]):
    def __init__(self, make: Callable[[], AbstractContextManager[A]]):
        self._make, self._lock = make, threading.RLock()
        self._open: AbstractContextManager[A] | None = None
        self._value: A | None = None

    @contextmanager
    def opened(self) -> Iterator[A]:
        """Use the resource, opening it if it is closed; it stays open."""
        with self._lock:
            if self._open is None:
                made = self._make()
                self._value = made.__enter__()
                self._open = made
            yield self._value

    @contextmanager
    def closed(self) -> Iterator[None]:
        """Do something while the resource is closed."""
        with self._lock:
            self.close()
            yield

    def close(self) -> None:
        with self._lock:
            made, self._open, self._value = self._open, None, None
            if made is not None:
                made.__exit__(None, None, None)
