"""A streaming data source over any broker of shards: Kinesis, PubSub and NSQ plug in as clients.

Spark owns the offsets: a batch is a range of sequence numbers of each shard, and one that was not
committed is read again. Clients are made from a name, ``module:function``, as they are needed on the
driver and on executors. No broker's library is used here; the tests run a broker in files.
Options: ``maxRecordsPerShard``; ``parallelPullFactor``, by which the driver's cores are multiplied for the number of
tasks a shard's batch is read by (without it one); ``deadlineSeconds``, within which a client's ``extend`` is called again and again from the moment that a
batch is planned until it is committed; ``commitDebounceSeconds``, for which commits merge; ``commitDelaySeconds`` and ``commitAttempts`` of commits that
the broker throttles.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import leases
from .limits import initial_position


class ShardClient(Protocol):
    def shards(self) -> list[str]: ...

    def bounds(self, shard: str) -> tuple[int, int]:
        """First sequence number kept, and the one after the last."""

    def at_timestamp(self, shard: str, ms: int) -> int:
        """First sequence number that arrived at or after a time."""

    def read(self, shard: str, start: int, end: int) -> Iterator[tuple[int, bytes, str | None, int | None]]:
        """(sequence number, value, key, arrival in ms) from start up to, not including, end."""

    def committed(self, offsets: dict[str, int]) -> None:
        """All before these numbers was processed. May raise ``leases.Throttled`` or ``leases.LeaseLost``."""

    def extend(self, shard: str, start: int, end: int) -> None:
        """Keep these records for us; called on the driver, and only if ``deadlineSeconds`` is set."""


def client_of(options: dict[str, str]) -> ShardClient:
    module, _, function = options["client"].partition(":")
    return getattr(importlib.import_module(module), function)(options)


class _Range(InputPartition):
    def __init__(self, shard: str, start: int, end: int):
        self.shard, self.start, self.end = shard, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.limit = int(options.get("maxrecordspershard", 10_000))
        ms = options.get("timestamp")
        self.position = initial_position(options.get("initialposition", "TRIM_HORIZON"), int(ms) if ms else None)
        self.known: dict[str, int] = {}
        deadline = options.get("deadlineseconds")
        # this object lives on the driver as long as the query; tasks get copies, which keep nothing
        self._keeper = leases.Keeper(lambda *own: client_of(options).extend(*own), float(deadline)) if deadline else None
        self._commits = leases.Debounced(self._committed, float(options.get("commitdebounceseconds", 0)))

    def __getstate__(self) -> dict:
        return {"options": self.options, "limit": self.limit, "position": self.position, "known": self.known}

    def initialOffset(self) -> dict:
        client, (kind, ms) = client_of(self.options), self.position
        first = {"earliest": lambda s: client.bounds(s)[0], "latest": lambda s: client.bounds(s)[1], "timestamp": lambda s: client.at_timestamp(s, ms)}[kind]
        self.known = {s: first(s) for s in client.shards()}
        self._commits.done = dict(self.known)
        return dict(self.known)

    def latestOffset(self) -> dict:
        """Up to ``maxRecordsPerShard`` on; shards that appeared since begin at their start."""
        client = client_of(self.options)
        for s in client.shards():
            lo, hi = client.bounds(s)
            self.known[s] = max(self.known.get(s, lo), min(hi, self.known.get(s, lo) + self.limit))
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = {s: max(self.known.get(s, 0), n) for s, n in end.items()}
        if start:
            # Spark has committed all before, even if the process that was to say so ended before
            self._commits.add(start)
        client = client_of(self.options)
        factor = self.options.get("parallelpullfactor")
        pulls = leases.parallel_pulls(float(factor)) if factor else 1
        out = []
        for s, n in sorted(end.items()):
            at = start[s] if s in start else client.bounds(s)[0]
            step = max(1, -(-(n - at) // pulls))
            out += [_Range(s, k, min(k + step, n)) for k in range(at, n, step)]
        if self._keeper:
            self._keeper.hold((r.shard, r.start, r.end) for r in out)
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        for n, value, key, ms in client_of(self.options).read(partition.shard, partition.start, partition.end):
            yield value, key, partition.shard, n, None if ms is None else datetime.fromtimestamp(ms / 1000, timezone.utc)

    def commit(self, end: dict) -> None:
        """Spark has committed a batch; the broker hears of it now, or with the next ones."""
        self._commits.add(end)

    def _committed(self, offsets: dict) -> None:
        # a lost lease is another consumer's business, as is its commit
        leases.commit(lambda: client_of(self.options).committed(offsets), float(self.options.get("commitdelayseconds", 1)), int(self.options.get("commitattempts", 10)), time.sleep)
        if self._keeper:
            self._keeper.release(offsets)

    def stop(self) -> None:
        """Called if Spark leaves the source's process the time; else the next start tells the broker what this would."""
        self._commits.flush()
        if self._keeper:
            self._keeper.close()


class ShardedSource(DataSource):
    """``spark.readStream.format("sharded").option("client", "module:function")`` after ``spark.dataSource.register(ShardedSource)``."""

    @classmethod
    def name(cls) -> str:
        return "sharded"

    def schema(self) -> str:
        return "value binary, key string, shard string, offset long, source_ts timestamp"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))
