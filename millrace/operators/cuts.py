"""Runs of rows that each begin where the one before ends, found in parallel.

A batch, an arrival-time window or a debounced commit is a run of consecutive rows of a group, a *cell*. Where a cell ends depends
only on its first row (and, for windows that grow, on its length), so the rule is a jump from row to row. A group's rows may
be dealt to any number of tasks in ranges of their order:

1. Each task builds the jump table of its range by binary search in prefix sums and arrival times, follows all jumps to the end of the range by
   pointer doubling, and gives a map from what may be pending when the range begins to what is pending at its end. A pending cell
   can only end within one cell's rows from the start, so the map holds no more of them.
2. The maps are composed in order of the ranges, one look-up each, which gives each range the cell that is pending when it begins.
3. Each task streams through its rows again and numbers them.

A range with the end of a group in it ends in the same way whatever was pending, so its map is a single state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime.shared import checkpointed


@dataclass(frozen=True)
class Rule:
    """When a cell ends: before the first row that any part of the rule keeps out.

    ``weights`` says what ``max_weight`` does: "before" the row with which it would be passed, "after" the row with
    which it is passed, or at "reach" as soon as it is reached, where a row of that weight is a cell of its own. ``max_records`` is a
    number of rows. A cell that opened at a time lasts for ``lengths[level]``, and a row that arrives as it ends is
    outside. With ``growing`` the first cell of a group or boundary has level 0 and each later one the next, up to the last; that first cell may end before its first row, and then
    counts as an empty one.
    """

    max_weight: int | None = None
    weights: str = "before"
    max_records: int | None = None
    lengths: tuple[int, ...] = ()
    growing: bool = False

    @property
    def levels(self) -> int:
        return len(self.lengths) if self.growing else 1

    def after(self, level: int) -> int:
        return min(level + 1, self.levels - 1)


@dataclass(frozen=True)
class Pending:
    """The cell that is open between two rows: what it holds so far, when it opened, its level and its number in the group."""

    weight: int
    records: int
    opened: int
    level: int
    number: int

    def values(self) -> list[int]:
        return [self.weight, self.records, self.opened, self.level, self.number]


class Stretch:
    """Consecutive sorted rows of one or more groups, and where each cell that may begin in them ends."""

    def __init__(self, rule: Rule, group: np.ndarray, boundary: np.ndarray, weight: np.ndarray, time: np.ndarray, start: np.ndarray):
        self.rule, self.group, self.boundary, self.time, self.start = rule, group, boundary, time, start
        self.n = n = len(group)
        self.sums = np.concatenate(([0], np.cumsum(weight)))
        #: whether a row begins a group, or a group or a boundary; the first row is the caller's to judge
        self.new_group, self.forced = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
        self.new_group[1:n] = group[1:] != group[:-1]
        self.forced[1:n] = self.new_group[1:n] | (boundary[1:] != boundary[:-1])
        self.segments = np.concatenate((np.zeros(min(n, 1), dtype=np.int64), np.flatnonzero(self.forced), [n]))
        self.segment_end = np.repeat(self.segments[1:], np.diff(self.segments)) if n else np.zeros(0, dtype=np.int64)
        if rule.weights == "reach" and rule.max_weight is not None:
            heavy = np.where(weight >= rule.max_weight, np.arange(n), n)
            self.next_heavy = np.append(np.minimum.accumulate(heavy[::-1])[::-1], n)
        self.weight = weight

    def ends(self, at: np.ndarray, weight, records, end: np.ndarray, deadline: np.ndarray | None) -> np.ndarray:
        """The first row from ``at`` on that does not belong to a cell with that much in it, at most ``end``."""
        rule, out = self.rule, end
        if rule.max_weight is not None:
            most = rule.max_weight - weight + self.sums[at]
            past = np.searchsorted(self.sums, most, side="right")
            if rule.weights == "before":
                past = past - 1
            elif rule.weights == "reach":
                past = np.minimum(np.minimum(past - 1, np.searchsorted(self.sums, most)), self.next_heavy[at])
            out = np.minimum(out, past)
        if rule.max_records is not None:
            out = np.minimum(out, at + np.maximum(0, rule.max_records - records))
        if deadline is not None:
            out = np.minimum(out, deadline)
        return np.maximum(out, at)

    def jumps(self, level: int) -> np.ndarray:
        """For a cell of that level from each row, the row after it."""
        at = np.arange(self.n)
        late = None
        if self.rule.lengths:
            length = self.rule.lengths[level]
            late = np.empty(self.n, dtype=np.int64)
            for low, high in zip(self.segments[:-1], self.segments[1:]):
                late[low:high] = low + np.searchsorted(self.time[low:high], self.time[low:high] + length)
        return self.ends(at + 1, self.weight, 1, self.segment_end, late)

    def first_end(self, pending: Pending) -> int:
        """Where a cell ends that is pending when the stretch begins, if its first row goes on with it."""
        end = np.array([self.segments[1]])
        late = np.searchsorted(self.time[: end[0]], [pending.opened + self.rule.lengths[pending.level]]) if self.rule.lengths else None
        return int(self.ends(np.zeros(1, dtype=np.int64), pending.weight, pending.records, end, late)[0])

    def opening(self, row: int, new_group: bool) -> tuple[int, int, int, int]:
        """For the first cell of a group or boundary: its level, when it opened, the empty cells before it, and the row after it."""
        opened = int(self.start[row] if new_group else self.time[row])
        if self.rule.growing and self.time[row] >= opened + self.rule.lengths[0]:
            return self.rule.after(0), int(self.time[row]), 1, -1
        late = None
        if self.rule.lengths:
            low, high = row, self.segment_end[row]
            late = low + np.searchsorted(self.time[low:high], [opened + self.rule.lengths[0]])
        end = self.ends(np.array([row + 1]), self.weight[row], 1, np.array([self.segment_end[row]]), late)
        return 0, opened, 0, int(end[0])

    def number(self, pending: Pending | None, forced: bool) -> tuple[np.ndarray, np.ndarray, Pending]:
        """Each row's cell number and when its cell opened, and what is pending after the last row.

        ``pending`` is None at the start of a group; ``forced`` says that the first row has another boundary.
        """
        tables = [self.jumps(level).tolist() for level in range(self.rule.levels)]
        firsts, numbers, openings = [], [], []
        row, number, level = 0, -1, 0
        begins, opens_group = True, pending is None
        if pending is not None:
            number, begins = pending.number, forced
            if not forced:
                row, level = self.first_end(pending), self.rule.after(pending.level)
                if row == self.n:
                    through = Pending(pending.weight + int(self.sums[-1]), pending.records + self.n, pending.opened, pending.level, number)
                    return np.full(self.n, number), np.full(self.n, pending.opened), through
                begins, opens_group = bool(self.forced[row]), bool(self.new_group[row])
                if row:
                    firsts, numbers, openings = [0], [number], [pending.opened]
        while row < self.n:
            after, opened = -1, int(self.time[row])
            if begins:
                level, opened, empty, after = self.opening(row, opens_group)
                number = (0 if opens_group else number + 1) + empty
            else:
                number += 1
            firsts.append(row)
            numbers.append(number)
            openings.append(opened)
            last, last_level = row, level
            row = tables[level][row] if after < 0 else after
            begins, opens_group, level = bool(self.forced[row]), bool(self.new_group[row]), self.rule.after(level)
        sizes = np.diff([*firsts, self.n])
        left = Pending(int(self.sums[-1] - self.sums[last]), self.n - last, openings[-1], last_level, number)
        return np.repeat(np.array(numbers, dtype=np.int64), sizes), np.repeat(np.array(openings, dtype=np.int64), sizes), left

    def map_(self) -> dict:
        """What is pending after the stretch, for all that may be pending before it; see ``follow``."""
        rule, n = self.rule, self.n
        ends = {"n": n, "single": not self.new_group.any(), "fresh": self.number(None, True)[2].values()}
        if not ends["single"]:
            return ends | {"weights": [], "times": [], "forced": False, "sums": 0, "exits": []}
        # jumps between (level, row), by doubling; a cell that is still open at the end leads to itself
        to = np.empty((rule.levels, n), dtype=np.int64)
        for level in range(rule.levels):
            row = self.jumps(level)
            inside = row < n
            target = np.where(self.forced[np.minimum(row, n)], 0, rule.after(level))
            empty_first = rule.growing and rule.lengths[0] <= 0  # a first window of no length is empty
            if empty_first:
                target = np.full(n, rule.after(level))
            to[level] = np.where(inside, target * n + row, level * n + np.arange(n))
        to = to.reshape(-1)
        steps = (to != np.arange(len(to))).astype(np.int64)
        if rule.growing and rule.lengths[0] <= 0:
            steps += steps * self.forced[np.minimum(to % n, n)]
        while True:
            further = to[to]
            if np.array_equal(further, to):
                break
            steps, to = steps + steps[to], further
        # no pending cell ends later than one that has nothing yet and the full length before it
        last = self.first_end(Pending(0, 0, int(self.time[0]), rule.levels - 1, 0))
        rows = np.arange(min(last, n - 1) + 1)
        nodes = (np.arange(rule.levels)[:, None] * n + rows).reshape(-1)
        at, level = to[nodes] % n, to[nodes] // n
        exits = [self.sums[-1] - self.sums[at], n - at, self.time[at], level, steps[nodes]]
        return ends | {"weights": self.weight[:last].tolist(), "times": self.time[:last].tolist(), "forced": bool(self.forced[min(last, n)]), "sums": int(self.sums[-1]), "exits": [x.tolist() for x in exits]}


def follow(rule: Rule, found: dict, pending: Pending | None, forced: bool) -> Pending:
    """What is pending after a stretch of which ``found`` is the map."""
    if pending is None or not found["single"]:
        return Pending(*found["fresh"])
    row, level, number = 0, 0, pending.number + 1
    if not forced:
        head = len(found["weights"])
        zero = np.zeros(head, dtype=np.int64)
        weights, times = (np.array(found[x], dtype=np.int64) for x in ("weights", "times"))
        row = Stretch(rule, zero, zero, weights, times, times).first_end(pending) if head else 0
        if row == found["n"]:
            return Pending(pending.weight + found["sums"], pending.records + row, pending.opened, pending.level, pending.number)
        forced = row == head and found["forced"]
        level = 0 if forced else rule.after(pending.level)
    if forced and rule.growing and rule.lengths[0] <= 0:
        number, level = number + 1, rule.after(0)
    width = len(found["exits"][0]) // rule.levels
    weight, records, opened, level, steps = (x[level * width + row] for x in found["exits"])
    return Pending(weight, records, opened, level, number + steps)


_MAP = "part int, first_group long, last_group long, first_boundary long, last_boundary long, n long, single boolean, fresh array<long>, weights array<long>, times array<long>, forced boolean, sums long, exits array<array<long>>"
_ENTRY = "part int, last_group long, last_boundary long, pending array<long>"


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema))


def cut_rows(df: DataFrame, group: list[str], order: list[str], rule: Rule, number: str, weight: Column | None = None, time: Column | None = None, start: Column | None = None, boundary: str | None = None, opened: str | None = None) -> DataFrame:
    """Append ``number`` (and ``opened``) of each row's cell, counted from 0 in each group.

    Rows are taken in order of ``time``, if the rule has one, and ``order``, which together should have no ties; nulls come first and a null group is a group. Null
    and negative weights are 0 and a null time is 0. One shuffle in ranges of (group, order), so that a group of any length is many tasks' work; the sorted rows
    are written once to the shared folder, as all three steps read the same ranges. A task holds its range's numbers, never its rows.
    """
    zero = F.lit(0).cast("long")
    of = lambda c: F.coalesce(c.cast("long"), zero) if c is not None else zero
    names = df.columns
    helpers = {
        "_g": F.xxhash64(*group) if group else zero, "_b": F.xxhash64(boundary) if boundary else zero,
        "_w": F.greatest(of(weight), zero), "_t": of(time), "_s": of(start if start is not None else time),
    }
    rows = df.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)], *[c.alias(h) for h, c in helpers.items()])
    keys = [*(f"c{names.index(c)}" for c in group), *(["_t"] if time is not None else []), *(f"c{names.index(c)}" for c in order)] or ["_g"]
    ranges = checkpointed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys))

    map_kind, entry_kind = _arrow(_MAP), _arrow(_ENTRY)

    def stretch(batch) -> Stretch:
        columns = (batch[c].to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[c].to_numpy() for c in ("_g", "_b", "_w", "_t", "_s"))
        return Stretch(rule, *columns)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            own = stretch(pa.Table.from_batches(held))
            edges = {"part": TaskContext.get().partitionId(), "first_group": int(own.group[0]), "last_group": int(own.group[-1]), "first_boundary": int(own.boundary[0]), "last_boundary": int(own.boundary[-1])}
            yield pa.RecordBatch.from_pylist([edges | own.map_()], schema=map_kind)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, group_before, boundary_before = None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                found = batch.slice(k, 1).to_pylist()[0]
                if found["first_group"] != group_before:
                    pending = None
                yield pa.RecordBatch.from_pylist([{"part": found["part"], "last_group": group_before, "last_boundary": boundary_before, "pending": pending and pending.values()}], schema=entry_kind)
                pending = follow(rule, found, pending, found["first_boundary"] != boundary_before)
                group_before, boundary_before = found["last_group"], found["last_boundary"]

    maps = ranges.select(*helpers).mapInArrow(build, _MAP)
    # a row a task, in one task: each is looked up once, in order
    entries = maps.repartition(1).sortWithinPartitions("part").mapInArrow(compose, _ENTRY).collect()
    sent = df.sparkSession.sparkContext.broadcast({e.part: (Pending(*e.pending) if e.pending else None, e.last_boundary) for e in entries})

    def number_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, boundary_before = sent.value.get(TaskContext.get().partitionId(), (None, None))
        group_before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = stretch(batch)
            if group_before is not None and own.group[0] != group_before:
                pending = None
            numbers, openings, pending = own.number(pending, own.boundary[0] != boundary_before)
            group_before, boundary_before = own.group[-1], own.boundary[-1]
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(numbers), *([pa.array(openings)] if opened else [])], names=added)

    added = [*names, number, *([opened] if opened else [])]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{c}` long" for c in added[len(names) :])])
    return ranges.mapInArrow(number_rows, schema)
