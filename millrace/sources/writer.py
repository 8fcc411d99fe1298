"""A sink for batches and streams: ``df.write.format("records")`` and ``df.writeStream.format("records")``.

Tasks send their own rows in requests and tell in a commit message what they sent, so a task that failed sends its own rows
again and no others. Options: ``client`` (``module:function``, called with the options in each task), ``limits`` (kinesis, pubsub, nsq or kafka),
``attempts`` a request (without it, without end), ``firstDelay`` and ``maxDelay`` in seconds, ``onlyFailed`` (false: a request is sent again as a whole) and ``log``, a
shared folder in which each committed epoch of a stream leaves its counts: an epoch that Spark delivers again after that is not sent again.
"""

from __future__ import annotations

import importlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from . import limits
from .sinks import Record, send

LIMITS = {"kinesis": limits.KINESIS, "pubsub": limits.PUBSUB, "nsq": limits.NSQ, "kafka": limits.KAFKA}


@dataclass
class Sent(WriterCommitMessage):
    records: int
    bytes: int


class _Log:
    """Counts of committed epochs in a folder of any file system that Arrow knows."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)

    def has(self, epoch: int) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(f"{self.folder}/{epoch}.json").type == fs.FileType.File

    def add(self, epoch: int, counts: dict) -> None:
        self.fs.create_dir(self.folder, recursive=True)
        hidden = f"{self.folder}/.{epoch}.json"
        with self.fs.open_output_stream(hidden) as out:
            out.write(json.dumps(counts).encode())
        self.fs.move(hidden, f"{self.folder}/{epoch}.json")


class _Writer:
    def __init__(self, options: dict[str, str], names: list[str]):
        self.options, self.names = options, names

    def _send(self, rows: Iterator) -> Sent:
        o, sizes = self.options, []

        def records() -> Iterator[Record]:
            for r in rows:
                # by place: rows that Spark hands over need not have names
                values = dict(zip(self.names, r))
                record = Record(bytes(values["value"] or b""), values.get("key"), tuple((values.get("headers") or {}).items()))
                sizes.append(record.size())
                yield record

        own = records()
        first = next(own, None)
        if first is None:
            return Sent(0, 0)
        module, _, function = o["client"].partition(":")
        client = getattr(importlib.import_module(module), function)(o)
        how = {"first_delay": float(o.get("firstdelay", 0.1)), "max_delay": float(o.get("maxdelay", 1)), "only_failed": o.get("onlyfailed", "true") == "true", "attempts": int(o["attempts"]) if "attempts" in o else None}
        send(client, itertools.chain([first], own), LIMITS[o.get("limits", "kafka")], **how)
        return Sent(len(sizes), sum(sizes))


class _BatchWriter(_Writer, DataSourceWriter):
    def write(self, iterator: Iterator) -> Sent:
        return self._send(iterator)


class _StreamWriter(_Writer, DataSourceStreamWriter):
    def _log(self) -> _Log | None:
        return _Log(self.options["log"]) if "log" in self.options else None

    def write(self, iterator: Iterator) -> Sent:
        epoch, log = TaskContext.get().getLocalProperty("streaming.sql.batchId"), self._log()
        if log and epoch is not None and log.has(int(epoch)):
            return Sent(0, 0)
        return self._send(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        log = self._log()
        if log and not log.has(batchId):
            own = [m for m in messages if m is not None]
            log.add(batchId, {"records": sum(m.records for m in own), "bytes": sum(m.bytes for m in own), "tasks": len(own)})

    def abort(self, messages: list, batchId: int) -> None:
        """Nothing can be taken back from a broker: the epoch has no entry, so all of it is sent again."""


class RecordSink(DataSource):
    """``spark.dataSource.register(RecordSink)``; takes columns value (binary), and key and headers if there are any (see ``sinks.sinkable``)."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def _names(self, schema) -> list[str]:
        names = [f.name for f in schema.fields]
        if "value" not in names:
            raise ValueError("a record sink needs a column named value")
        return names

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(dict(self.options), self._names(schema))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(dict(self.options), self._names(schema))
