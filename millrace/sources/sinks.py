"""Sinks: records value, key and headers, written by the tasks that hold them."""

from __future__ import annotations

import itertools
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime.retry import fibonacci
from .limits import KafkaSink, RequestLimits


def sinkable(value: Column, key: Column | None = None, headers: Column | None = None) -> list[Column]:
    """The columns of a sink: value, key (null: none) and headers (none: empty)."""
    return [
        value.cast("binary").alias("value"),
        (F.lit(None) if key is None else key).cast("string").alias("key"),
        (F.create_map() if headers is None else headers).cast("map<string,string>").alias("headers"),
    ]


def for_kafka(df: DataFrame) -> DataFrame:
    """Records as Spark's Kafka writer takes them: a random key where there is none, headers in UTF-8."""
    headers = F.transform(F.map_entries("headers"), lambda e: F.struct(e["key"].alias("key"), F.encode(e["value"], "UTF-8").alias("value")))
    return df.select(F.coalesce("key", F.uuid()).alias("key"), "value", headers.alias("headers"))


def write_kafka(df: DataFrame, sink: KafkaSink) -> None:
    """Write ``sinkable`` columns to a topic by Spark's own writer; its connector must be on the class path."""
    for_kafka(df).write.format("kafka").options(**sink.options()).save()


class RecordTooLarge(ValueError):
    """A record that the broker would never take, however often it is sent."""


@dataclass(frozen=True)
class Record:
    value: bytes
    key: str | None = None
    headers: tuple[tuple[str, str], ...] = ()

    def size(self, counts_key: bool = False) -> int:
        return len(self.value) + (len((self.key or "").encode()) if counts_key else 0)


class Client(Protocol):
    def put(self, records: list[Record]) -> list[str | None]:
        """Send one request; for each record None, or the error it failed with."""


def requests(records: Iterable[Record], limits: RequestLimits) -> Iterator[list[Record]]:
    """Records in requests: a new one opens before the record that would pass a limit.

    A record over the limit of a request goes alone; one over the limit of a record is an error.
    """
    held: list[Record] = []
    size = 0
    for r in records:
        n = r.size(limits.counts_key)
        if limits.max_record_bytes is not None and n > limits.max_record_bytes:
            raise RecordTooLarge(f"a record has {n} bytes; the broker takes {limits.max_record_bytes}")
        if held and (len(held) + 1 > limits.max_records or size + n > limits.max_bytes):
            yield held
            held, size = [], 0
        held.append(r)
        size += n
    if held:
        yield held


def send(client: Client, records: Iterable[Record], limits: RequestLimits, first_delay: float = 0.1, max_delay: float = 1.0, only_failed: bool = True, attempts: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Send all records, a request at a time, and return their number.

    What failed is sent again after growing delays, without end unless ``attempts`` is given:
    just the failed records, or the whole request where a broker cannot tell them apart.
    """
    sent = 0
    for request in requests(records, limits):
        todo = request
        for tried, delay in zip(itertools.count(1), fibonacci(first_delay, max_delay)):
            errors = client.put(todo)
            failed = [r for r, e in zip(todo, errors) if e is not None]
            if not failed:
                break
            if attempts is not None and tried >= attempts:
                raise OSError(f"{len(failed)} records failed: {', '.join(sorted({e for e in errors if e}))}")
            todo = failed if only_failed else request
            sleep(delay)
        sent += len(request)
    return sent


def write(df: DataFrame, make_client: Callable[[], Client], limits: RequestLimits, **how) -> None:
    """Send a DataFrame of ``sinkable`` columns from the tasks, each with a client of its own."""

    def part(rows) -> None:
        own = (Record(bytes(r.value), r.key, tuple((r.headers or {}).items())) for r in rows)
        first = next(own, None)
        if first is not None:
            send(make_client(), itertools.chain([first], own), limits, **how)

    df.select("value", "key", "headers").foreachPartition(part)


class HttpClient:
    """Posts each record's bytes to an address, up to ``parallel`` at once; keys and headers are not sent."""

    def __init__(self, address: str, parallel: int = 8):
        self.address, self._pool = address, ThreadPoolExecutor(parallel)

    def put(self, records: list[Record]) -> list[str | None]:
        return list(self._pool.map(self._post, records))

    def _post(self, record: Record) -> str | None:
        request = urllib.request.Request(self.address, record.value, {"Content-Type": "application/octet-stream"}, method="POST")
        try:
            urllib.request.urlopen(request, timeout=30).close()
            return None
        except urllib.error.HTTPError as e:
            return f"{e.code} {e.read().decode(errors='replace')}"
        except OSError as e:
            return str(e)


def http_client(options: dict[str, str]) -> HttpClient:
    """The client of ``format("records")`` that posts to option ``address``."""
    return HttpClient(options["address"], int(options.get("parallel", 8)))


def partitions_healthy(leaders: list[int | None]) -> bool:
    """A topic is healthy if it has partitions and each has a leader."""
    return bool(leaders) and all(x is not None and x >= 0 for x in leaders)


def any_open(pages: Iterable[list[bool]]) -> bool:
    """A stream is healthy if any shard on any page of its list is open."""
    return any(any(p) for p in pages)
