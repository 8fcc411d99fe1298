"""Record-framed compression: unpack messages into payloads, pack payloads into messages.

Inside the compressed stream: byte 0 is the format's version (1), byte 1 the payload version, then
records of a big-endian 32-bit length and that many bytes. Plain messages never reach Python.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import codec
from .deadletters import too_large_message
from .folds import split_by_bytes

FORMAT_VERSION = 1


@dataclass(frozen=True)
class Limits:
    """Bytes of a batch (soft) and of one payload (hard); both must be positive."""

    max_bytes_in_batch: int
    max_bytes_single_payload: int

    def __post_init__(self):
        if self.max_bytes_in_batch <= 0 or self.max_bytes_single_payload <= 0:
            raise ValueError("decompression limits must be positive")


def _rows(batch: pa.RecordBatch, at_once: int = 16) -> Iterator[tuple]:
    """A batch's rows, a few at a time: a batch has thousands of messages, and copies of all would stay beside it."""
    for k in range(0, batch.num_rows, at_once):
        yield from zip(*(c.to_pylist() for c in batch.slice(k, at_once).columns))
    # what was freed goes back, as workers live on
    pa.default_memory_pool().release_unused()


def _reader(kind: str, message: bytes) -> io.RawIOBase:
    if kind == "gzip":
        return gzip.GzipFile(fileobj=io.BytesIO(message))
    import zstandard

    # across frames, so that what follows a frame must be a frame as well
    return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(message), read_across_frames=True)


def _exactly(stream, n: int, keep: bool = True) -> bytes | None:
    """``n`` bytes, b"" at a clean end, or EOFError in the middle; read in pieces, and dropped if not kept."""
    parts, left = [], n
    while left:
        part = stream.read(min(left, 1 << 16))
        if not part:
            if left == n:
                return b""
            raise EOFError
        left -= len(part)
        if keep:
            parts.append(part)
    return b"".join(parts) if keep else None


def records(kind: str, message: bytes, max_single: int) -> Iterator[tuple[bytes | None, int | None, str | None]]:
    """(payload, payload version, error) of each record; records before an error are kept.

    A payload over the limit is an error of its own and reading goes on; a negative length or a
    broken stream ends the message.
    """
    import zstandard

    corrupt = f"corrupt {kind}-compressed payload"
    try:
        stream = _reader(kind, message)
        head = _exactly(stream, 2)
        if len(head) < 2:
            yield None, None, corrupt
            return
        if head[0] != FORMAT_VERSION:
            yield None, None, f"unsupported versions in {kind}-compressed record header: {head[0]}, {head[1]}"
            return
        while size := _exactly(stream, 4):
            (n,) = struct.unpack(">i", size)
            if n < 0:
                raise EOFError
            if n > max_single:
                _exactly(stream, n, keep=False)
                yield None, head[1], too_large_message(max_single, kind)
                continue
            payload = _exactly(stream, n) if n else b""
            if len(payload) < n:
                raise EOFError
            yield payload, head[1], None
    except (EOFError, OSError, zlib.error, zstandard.ZstdError):
        yield None, None, corrupt


def decompress(df: DataFrame, limits: Limits, payload: str = "payload", ordinal: str = "ordinal") -> DataFrame:
    """Rows (ordinal, codec, record, payload, payload_version, error, original) of messages.

    ``ordinal`` numbers the messages. Plain ones pass through as record 0 without a payload
    version; a bad row has ``error`` and, in ``original``, the whole message. A null message is
    plain. Narrow: nothing is shuffled.
    """
    sniffed = df.select(F.col(ordinal).cast("long").alias("ordinal"), codec(F.col(payload)).alias("codec"), F.col(payload).alias("payload"))
    schema = "ordinal long, codec string, record int, payload binary, payload_version int, error string, original binary"
    plain = sniffed.filter("codec = 'plain'").select("ordinal", "codec", F.lit(0).alias("record"), "payload", F.lit(None).cast("int").alias("payload_version"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("binary").alias("original"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            rows, held = [], 0
            for number, kind, message in _rows(batch):
                for k, (data, v, error) in enumerate(records(kind, message, limits.max_bytes_single_payload)):
                    rows.append((number, kind, k, data, v, error, message if error else None))
                    held += len(data or b"") + (len(message) if error else 0)
                    if held > 1 << 21:  # a message may expand without bound
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return plain.unionByName(sniffed.filter("codec <> 'plain'").mapInArrow(run, schema))


def decompressed_batches(df: DataFrame, limits: Limits, payload: str = "payload", ordinal: str = "ordinal") -> DataFrame:
    """``decompress`` plus ``batch_no`` and ``is_last``: plain, then zstd, then gzip; the last batch carries the token.

    ``df`` is one source batch, as ``foreachBatch`` hands it over. An empty input has no rows: its
    token is acknowledged by the caller.
    """
    return with_batches(decompress(df, limits, payload, ordinal), limits)


def with_batches(rows: DataFrame, limits: Limits) -> DataFrame:
    """Number the batches of decompressed rows, which are read twice: persist them.

    Plain payloads are one batch; compressed ones are split after the record that passes the soft
    limit, going on from message to message of a codec. What is gone through in order are the records' sizes, a codec's in as many tasks as they
    need; payloads stay where they are, but for a join on the record.
    """
    size = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")
    packed = rows.filter("codec <> 'plain'")
    cut = split_by_bytes(packed.select("codec", "ordinal", "record", size.alias("size")), ["codec"], ["ordinal", "record"], "size", limits.max_bytes_in_batch)
    cut = cut.select("codec", "ordinal", "record", F.col("batch_no").alias("part"))
    parted = rows.filter("codec = 'plain'").withColumn("part", F.lit(0).cast("long")).unionByName(packed.join(cut, ["codec", "ordinal", "record"]))
    # a row a codec
    plain = rows.filter("codec = 'plain'").limit(1).select("codec", F.lit(1).cast("long").alias("n"))
    counts = plain.unionByName(cut.groupBy("codec").agg((F.max("part") + 1).alias("n")))
    rank = F.when(F.col("codec") == "plain", 0).when(F.col("codec") == "zstd", 1).otherwise(2)
    bases = counts.select(F.col("codec").alias("_codec"), (F.sum("n").over(Window.orderBy(rank)) - F.col("n")).alias("_base"), F.sum("n").over(Window.partitionBy()).alias("_all"))
    numbered = parted.join(F.broadcast(bases), F.col("codec") == F.col("_codec")).withColumn("batch_no", F.col("_base") + F.col("part"))
    return numbered.withColumn("is_last", F.col("batch_no") == F.col("_all") - 1).drop("part", "_codec", "_base", "_all")


class Packer:
    """A compressed message of at most ``target`` bytes; ``add`` refuses the record that would pass it."""

    #: Bytes that closing the stream may still add (fixed values).
    FOOTER = {"gzip": 10, "zstd": 3}

    def __init__(self, kind: str, target: int, payload_version: int = 1, level: int | None = None):
        self.kind, self.target = kind, target
        self.parts: list[bytes] = []
        self.size = 0
        head = bytes((FORMAT_VERSION, payload_version))
        if kind == "gzip":
            self._deflate = zlib.compressobj(6 if level is None else level, zlib.DEFLATED, -15)
            self._crc, self._length = 0, 0
            self._write(b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff")
        else:
            import zstandard

            self._level = 3 if level is None else level
            self._zstd = zstandard.ZstdCompressor(level=self._level, write_checksum=False, write_content_size=False).compressobj()
            self._flush = zstandard.COMPRESSOBJ_FLUSH_BLOCK
            self._written: list[bytes] = []
            self._refused = False
        self._raw(head)

    def _write(self, data: bytes) -> None:
        self.parts.append(data)
        self.size += len(data)

    def _raw(self, data: bytes) -> None:
        if self.kind == "gzip":
            self._crc, self._length = zlib.crc32(data, self._crc), self._length + len(data)
            self._write(self._deflate.compress(data))
        else:
            self._written.append(data)
            self._write(self._zstd.compress(data))

    def add(self, record: bytes) -> bool:
        framed = struct.pack(">i", len(record)) + record
        if self.kind == "gzip":
            trial = self._deflate.copy()
            out = trial.compress(framed) + trial.flush(zlib.Z_SYNC_FLUSH)
            if self.size + len(out) + self.FOOTER["gzip"] > self.target:
                return False
            self._deflate = trial
            self._crc, self._length = zlib.crc32(framed, self._crc), self._length + len(framed)
            self._write(out)
            return True
        if self._refused:
            self._again()
        out = self._zstd.compress(framed) + self._zstd.flush(self._flush)
        if self.size + len(out) + self.FOOTER["zstd"] > self.target:
            # the stream cannot go back; what was given out so far ends with a record, and is kept as it is
            self._refused = True
            return False
        self._written.append(framed)
        self._write(out)
        return True

    def _again(self) -> None:
        """Write what was accepted once more, for the record after one that was refused."""
        import zstandard

        self._refused = False

        self._zstd = zstandard.ZstdCompressor(level=self._level, write_checksum=False, write_content_size=False).compressobj()
        self.parts, self.size = [], 0
        for k, data in enumerate(self._written):
            self._write(self._zstd.compress(data) + (self._zstd.flush(self._flush) if k else b""))

    def result(self) -> bytes:
        if self.kind == "gzip":
            self._write(self._deflate.flush() + struct.pack("<II", self._crc, self._length & 0xFFFFFFFF))
        else:
            # after a refusal: an empty last block (fixed value of the format)
            self._write(b"\x01\x00\x00" if self._refused else self._zstd.flush())
        return b"".join(self.parts)


def compress(df: DataFrame, group: list[str], order: list[str], payload: str, kind: str, target: int, payload_version: int = 1) -> DataFrame:
    """Pack payloads greedily, in order within a group: (group..., message_no, n_records, message).

    A payload that alone passes the target makes a row with a null message and ``n_records`` 1,
    and keeps its bytes in ``rejected``. Groups are dealt by hash and streamed through.
    """
    names = [*group, "message_no", "n_records", "message", "rejected"]
    schema = ", ".join([*(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group), "message_no long, n_records long, message binary, rejected binary"])
    arrow = [*(None for _ in group), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, n, number, current, types = None, 0, 0, None, None

        def row(own, count, message, rejected=None):
            values = [*own, number, count, message, rejected]
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for batch in batches:
            types = types or [*(batch.column(k).type for k in range(len(group))), *arrow[len(group) :]]
            for *own, data in _rows(batch):
                if own != current:
                    if n:
                        yield row(current, n, packer.result())
                    packer, n, number, current = None, 0, 0, own
                data = data or b""
                packer = packer or Packer(kind, target, payload_version)
                if packer.add(data):
                    n += 1
                    continue
                if n:
                    yield row(own, n, packer.result())
                    number += 1
                packer, n = Packer(kind, target, payload_version), 0
                if packer.add(data):
                    n = 1
                else:
                    yield row(own, 1, None, data)
                    number, packer = number + 1, None
        if n:
            yield row(current, n, packer.result())

    dealt = df.repartition(*group) if group else df.repartition(1)
    return dealt.sortWithinPartitions(*group, *order).select(*group, F.col(payload).alias("_payload")).mapInArrow(run, schema)
