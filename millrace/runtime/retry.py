"""Retry policies around a driver-side action: setup errors without end, transient ones a few times."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import TypeVar

A = TypeVar("A")


def exponential(first: float, limit: float = float("inf")) -> Iterator[float]:
    delay = first
    while True:
        yield min(delay, limit)
        delay = min(delay * 2, limit)


def fibonacci(first: float, limit: float) -> Iterator[float]:
    """Delays that grow as the Fibonacci numbers, up to a limit."""
    a, b = first, first
    while True:
        yield min(a, limit)
        a, b = b, a + b


def full_jitter(first: float, limit: float = float("inf"), rng: random.Random | None = None) -> Iterator[float]:
    """Delays even between nothing and the exponential one."""
    rng = rng or random.Random()
    for delay in exponential(first, limit):
        yield rng.uniform(0, delay)


def causes(error: BaseException) -> Iterator[BaseException]:
    """An error and its causes, outermost first."""
    seen: set[int] = set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        yield error
        error = error.__cause__ or error.__context__


def messages_of(check: Callable[[BaseException], str | None], error: BaseException) -> list[str]:
    """The messages that ``check`` finds along the chain of causes."""
    return [m for e in causes(error) if (m := check(e)) is not None]


def joined(messages: list[str]) -> str:
    """Messages joined by ``": "``, without those that a neighbour contains."""
    out: list[str] = []
    for m in messages:
        if out and m in out[-1]:
            continue
        if out and out[-1] in m:
            out[-1] = m
        else:
            out.append(m)
    return ": ".join(out)


def with_retries(
    action: Callable[[int], A],
    setup_check: Callable[[BaseException], str | None],
    setup_delay: float,
    transient_delay: float,
    attempts: int,
    alert: Callable[[str], None] = lambda m: None,
    unhealthy: Callable[[], None] = lambda: None,
    healthy: Callable[[], None] = lambda: None,
    sleep: Callable[[float], None] = time.sleep,
    rng: random.Random | None = None,
) -> A:
    """The result of ``action(retry number)``.

    Setup errors, those that ``setup_check`` knows, raise an alert and are retried without end with
    exponential delays. Any other is retried ``attempts - 1`` times with full jitter.
    """
    setup, transient = exponential(setup_delay), full_jitter(transient_delay, rng=rng)
    tried = failed = 0
    while True:
        try:
            out = action(tried)
        except Exception as error:
            tried += 1
            if known := messages_of(setup_check, error):
                alert(joined(known))
                sleep(next(setup))
                continue
            unhealthy()
            failed += 1
            if failed >= attempts:
                raise
            sleep(next(transient))
        else:
            healthy()
            return out


#: Codes of remote calls that are worth another try (fixed values).
RETRYABLE_CODES = frozenset({"DEADLINE_EXCEEDED", "INTERNAL", "CANCELLED", "RESOURCE_EXHAUSTED", "ABORTED", "UNKNOWN", "UNAVAILABLE"})


def retryable(code: str, message: str = "") -> bool:
    """Whether a failed remote call may be tried again; a server that was shut down may not."""
    return code in RETRYABLE_CODES and not (code == "UNAVAILABLE" and "Server shutdownNow invoked" in message)
