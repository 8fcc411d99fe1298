"""Token-ID output: fixed-width bit packing with block offsets.

Format. Documents in ascending ``doc_id`` order are dealt to shards by range, so shard numbers
ascend with the ids. A shard is a run of blocks, each a row of a Parquet table: ``shard``,
``block``, ``bits`` (the least width that holds every id of the vocabulary), ``n_ids``,
``first_id`` (ids of the shard before this block), ``doc_ids``, ``doc_lens`` and ``payload``.
``payload`` holds id ``k`` in bits ``k*bits`` to ``(k+1)*bits - 1``, least significant first, so
that any id's place is computed and any slice unpacks without what precedes it. Blocks hold whole
documents; one longer than the target has a block of its own.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_partitions, text_or_empty
from .tokens import default_path, encoder

BLOCK_SCHEMA = "shard int, block int, bits int, n_ids long, first_id long, doc_ids array<long>, doc_lens array<long>, payload binary"


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least significant bit first; eight ids fill ``bits`` bytes."""
    if not 1 <= bits <= 32:
        raise ValueError("bits must be 1 to 32")
    groups = -(-len(ids) // 8)
    padded = np.zeros(groups * 8, dtype=np.uint64)
    padded[: len(ids)] = ids
    padded = padded.reshape(groups, 8)
    out = np.zeros((groups, bits), dtype=np.uint8)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        value = padded[:, k] << np.uint64(shift)
        for j in range((bits + shift + 7) // 8):
            out[:, byte + j] |= ((value >> np.uint64(8 * j)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack_bits(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count - 1`` of a payload, reading only their bytes."""
    lo, hi = start * bits // 8, -(-(start + count) * bits // 8)
    part = np.frombuffer(payload[lo:hi] + bytes(8), dtype=np.uint8)
    at = np.arange(start, start + count, dtype=np.int64) * bits - lo * 8
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    value = np.zeros(count, dtype=np.uint64)
    for j in range((bits + 7 + 7) // 8):
        value |= part[byte + j].astype(np.uint64) << np.uint64(8 * j)
    return ((value >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_token_blocks(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 0, block_ids: int = 262_144, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write the blocks to ``path``.

    Rows that repeat a ``doc_id`` are all kept, in order of their text's hash; a null ``doc_id``
    comes first. Empty tables give an empty archive. One shuffle, by range of ``doc_id``.
    """
    tokenizer = tokenizer or default_path("byte_bpe_50k.json")
    shards = shards or shuffle_partitions(docs.sparkSession)
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = encoder(tokenizer), TaskContext.get().partitionId()
        bits = max(1, (own.vocab_size - 1).bit_length())
        held: list[tuple[int | None, bytes]] = []
        size = number = first = 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(b for _, b in held), dtype="<u4")
            cols = [[shard], [number], [bits], [len(ids)], [first], [[d for d, _ in held]], [[len(b) // 4 for _, b in held]], [pack_bits(ids, bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                ids = own.encode(text) + end
                if held and size + len(ids) // 4 > block_ids:
                    yield block()
                    held, number, first, size = [], number + 1, first + size, 0
                held.append((doc_id, ids))
                size += len(ids) // 4
        if held:
            yield block()

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    key = ["id", F.xxhash64("text"), "row"]  # rows that repeat entirely can so be dealt apart
    rows.repartitionByRange(shards, *key).sortWithinPartitions(*key).select("id", "text").mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens and ids_crc32.

    Ids come from the files, block by block, unpacked with numpy. Offsets of the shards are a
    running sum over one row a shard.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, bits, n, first, docs, lens, payload in zip(*(c.to_pylist() for c in batch.columns)):
                ids = unpack_bits(payload, bits, 0, n).astype("<u4")
                ends = np.cumsum(np.array(lens, dtype=np.int64))
                crcs = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends.tolist(), lens)]
                cols = [pa.array([shard] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(first + ends - np.array(lens, dtype=np.int64)), pa.array(lens, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.record_batch(cols, names=["shard", "doc_id", "local", "n_tokens", "ids_crc32"])

    found = blocks.select("shard", "bits", "n_ids", "first_id", "doc_ids", "doc_lens", "payload").mapInArrow(digests, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # one row a shard, and the number of shards is a parameter
    return found.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """One document's ids by random access: its block is found by its list of ids, its slice alone unpacked."""
    row = spark.read.schema(BLOCK_SCHEMA).parquet(path).filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).first()
    if row is None:
        return None
    k = row.doc_ids.index(doc_id)
    return unpack_bits(row.payload, row.bits, sum(row.doc_lens[:k]), row.doc_lens[k]).tolist()


def token_archive(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = 0) -> DataFrame:
    """Write the documents' ids to a new archive in the shared folder and return its index.

    Null and empty texts are the end id alone, rows that repeat each have their ids, a null doc_id comes first, and an empty table
    gives an empty archive.
    """
    path = f"{shared_dir(docs.sparkSession)}/token-blocks-{uuid.uuid4().hex}"
    write_token_blocks(docs, path, tokenizer, end_id)
    return read_token_index(docs.sparkSession, path)
