"""Operators that go through rows in order: batching, arrival-time windows, debounced commits.

Each says by what rule a run of rows ends after its first row; ``cuts`` finds the runs, a group of any length in many tasks.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import Rule, cut_rows


def group_by_limits(df: DataFrame, group: list[str], order: list[str], size: str, max_records: int, max_bytes: int) -> DataFrame:
    """Append ``batch_no``: a new batch opens before the record that would pass either limit.

    At exactly a limit the batch stays open until the next record. A record over the byte limit
    has a batch of its own.
    """
    return cut_rows(df, group, order, Rule(max_bytes, "before", max_records), "batch_no", F.col(size))


def batch_up(df: DataFrame, group: list[str], order: list[str], weight: str, max_weight: int) -> DataFrame:
    """Append ``batch_no`` of greedy batches by weight: a batch that reaches the maximum is closed at once.

    An item of at least the maximum goes alone, after what was pending.
    """
    return cut_rows(df, group, order, Rule(max_weight, "reach"), "batch_no", F.col(weight))


def batch_up_with_timeout(df: DataFrame, group: list[str], order: list[str], weight: str, arrival_ms: str, max_weight: int, max_delay_ms: int) -> DataFrame:
    """Append ``batch_no`` of ``batch_up`` where a pending batch also closes ``max_delay_ms`` after it was opened.

    A replay over arrival times in milliseconds, in their order and then in ``order``: the timer starts when a batch becomes pending,
    not when it grows; an item that arrives as the timer ends finds the batch closed.
    """
    return cut_rows(df, group, order, Rule(max_weight, "reach", lengths=(max_delay_ms,)), "batch_no", F.col(weight), F.col(arrival_ms))


def split_by_bytes(df: DataFrame, group: list[str], order: list[str], size: str, max_bytes: int) -> DataFrame:
    """Append ``batch_no``: a batch closes after the record with which it passes ``max_bytes``."""
    return cut_rows(df, group, order, Rule(max_bytes, "after"), "batch_no", F.col(size))


def first_window_ms(duration_ms: int, scaling: float) -> int:
    return int(duration_ms * scaling)


def random_scaling(draw: Callable[[], float] = random.random) -> float:
    """A first window's share of the duration, from a quarter up to a half, so that applications started together do not commit together."""
    return 0.25 + 0.25 * draw()


def window_lengths(duration_ms: int, first_ms: int) -> tuple[int, ...]:
    """The lengths of a stream's windows: each twice the one before, up to the duration."""
    out = [first_ms]
    while out[-1] != (longer := min(2 * out[-1], duration_ms)):
        out.append(longer)
    return tuple(out)


def timed_windows(df: DataFrame, group: list[str], order: list[str], arrival_ms: str, duration_ms: int, first_scaling: float | None = 1.0, start_ms: str | None = None, boundary: str | None = None) -> DataFrame:
    """Append ``window_no`` and ``window_start_ms`` of tumbling windows over arrival time.

    The first window opens with the stream (``start_ms``, or the first row where that is not given)
    and lasts ``duration_ms * first_scaling`` (None: ``random_scaling``, drawn once); each later one opens with its first row and lasts
    twice its predecessor, ``duration_ms`` at most. A row that arrives as a window ends is outside
    it. A change of ``boundary`` (a rebalance, the end of a shard) closes the window and starts
    the scaling anew. Rows are taken in order of arrival and then of ``order``.
    """
    scaling = random_scaling() if first_scaling is None else first_scaling
    rule = Rule(lengths=window_lengths(duration_ms, first_window_ms(duration_ms, scaling)), growing=True)
    return cut_rows(df, group, order, rule, "window_no", time=F.col(arrival_ms), start=F.col(start_ms) if start_ms else None, boundary=boundary, opened="window_start_ms")


def debounce(df: DataFrame, group: list[str], order: list[str], arrival_ms: str, delay_ms: int) -> DataFrame:
    """Append ``commit_no``: acknowledgements merge until ``delay_ms`` after the first pending one; 0 commits each.

    Rows are taken in order of arrival and then of ``order``.
    """
    return cut_rows(df, group, order, Rule(lengths=(delay_ms,)), "commit_no", time=F.col(arrival_ms))


def repeat_periodically(df: DataFrame, group: list[str], at_ms: str, period_ms: int, until_ms: int) -> DataFrame:
    """Rows plus, after each quiet period, the last row again; column ``emitted_ms`` says when.

    A row is repeated every ``period_ms`` until the next one arrives, and to ``until_ms`` (exclusive) after the last.
    """
    from pyspark.sql import Window

    after = F.coalesce(F.lead(at_ms).over(Window.partitionBy(*group).orderBy(at_ms)), F.lit(until_ms))
    last = F.greatest(F.col(at_ms), after - 1)
    return df.withColumn("_until", last).withColumn("emitted_ms", F.explode(F.sequence(F.col(at_ms), F.col("_until"), F.lit(period_ms)))).drop("_until")


def chunk_numbers(df: DataFrame, group: list[str], order: list[str], size: int = 1000) -> DataFrame:
    """Append ``chunk_no``: runs of ``size`` rows of a group in order."""
    from pyspark.sql import Window

    return df.withColumn("chunk_no", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / size).cast("long"))
