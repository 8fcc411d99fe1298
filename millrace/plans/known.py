"""Families over a stream: a batch that holds nothing new resolves nothing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping

from ..functions.keys import Criterion
from .schemas import Family, Registry, Resolved, Version, clashing, resolve_family


class KnownFamilies:
    """Families and versions seen so far, and the columns they resolved to.

    ``resolved`` adds a batch's families and gives the columns of all of them, so that the columns of a stream only grow. A
    family is resolved when it, or a version of it, is new, when its columns are older than ``expiry`` seconds, or when it
    failed more than ``retry`` seconds ago; until then its failure stands. The driver holds a row a family.
    """

    def __init__(self, registry: Registry, skip: Iterable[Criterion] = (), expiry: float = 600.0, retry: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.registry, self.skip, self.expiry, self.retry, self.clock = registry, list(skip), expiry, retry, clock
        self.versions: dict[Family, frozenset[Version]] = {}
        #: what a family's versions resolved to (a column, a failure or nothing), and when
        self._found: dict[Family, tuple[frozenset[Version], object, bool, float]] = {}
        self.lookups = 0

    def resolved(self, families: Mapping[Family, Iterable[Version]]) -> Resolved:
        for family, versions in families.items():
            self.versions[family] = self.versions.get(family, frozenset()) | frozenset(versions)
        columns, failures = [], []
        for family, versions in sorted(self.versions.items()):
            before = self._found.get(family)
            stale = before is None or before[0] != versions or self.clock() - before[3] >= (self.retry if before[2] else self.expiry)
            if stale:
                self.lookups += 1
                column, failure = resolve_family(family, versions, self.registry, self.skip)
                before = self._found[family] = (versions, column or failure, failure is not None, self.clock())
            if before[2]:
                failures.append(before[1])
            elif before[1] is not None:
                columns.append(before[1])
        clashing(columns)
        return Resolved(tuple(columns), tuple(failures))
