"""Best-fit packing with certified bin counts.

Pieces are dealt to partitions by hash, each packed best-fit decreasing. Dual-feasible functions
give a lower bound on the bins of any set of pieces, and the bounds steer what follows. Once the bins so far
meet the bound of all pieces, no packing has fewer. Else the partitions with a gap, whose bins are above their
bound, put the documents of their unfilled bins into a common pool, which is dealt anew to fewer
partitions and packed again. If their pool meets its own bound, nothing can be saved in it, and the unfilled
bins of the certified partitions join: each is optimal for itself, but not all of them together.
Exchanges end when the pool meets its bound, fits one partition, or rounds save nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, tidied
from .tokens import default_path, encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode whole texts (null: empty), append ``end_id``, cut what is longer than ``capacity``.

    ``start`` counts the document's ids before the piece. With ``keep_ids`` the ids themselves
    follow as little-endian unsigned 32-bit bytes in column ``ids``. A document without any id
    (empty text and no end id) has no piece. Narrow: no shuffle.
    """
    tokenizer = tokenizer or default_path("word_bpe_49k.json")
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    width = 4 * capacity
    schema = PIECE_SCHEMA + (", ids binary" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: 6 if keep_ids else 5])
            cols = list(zip(*rows)) or [[]] * (6 if keep_ids else 5)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(cut, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by two families of dual-feasible functions.

    The first rounds items over ``capacity - e`` up to a bin and drops those under ``e``, for
    every ``e`` up to half a bin; the second is ``floor((k+1)x)/k`` for items whose ``(k+1)x`` is
    fractional. ``e = 0`` is the plain sum.
    """
    return _bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def _bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same from the number of items of each length."""
    count = count.astype(np.int64)
    sizes = np.arange(capacity + 1)
    number, mass = np.cumsum(count), np.cumsum(count * sizes)
    e = np.arange(capacity // 2 + 1)
    below = np.where(e > 0, mass[np.maximum(e - 1, 0)], 0)
    large = number[-1] - number[capacity - e]
    middle = mass[capacity - e] - below
    best = int(np.max(-(-(large * capacity + middle) // capacity)))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        # in units of 1/(k * capacity): exact multiples keep x, others floor((k+1)x)/k
        units = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * units).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the bin it leaves the least room in.

    Bins are kept by their room, and a bit mask of the rooms that occur finds the least that fits.
    """
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    by_room: dict[int, list[int]] = {}
    mask = made = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            own = by_room[room]
            bin_ = own.pop()
            if not own:
                mask &= ~(1 << room)
        else:
            bin_, room, made = made, capacity, made + 1
        bins[k], offsets[k] = bin_, capacity - room
        if left := room - need:
            by_room.setdefault(left, []).append(bin_)
            mask |= 1 << left
    return bins, offsets


def _pack(capacity: int, base: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy(dtype=np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        made, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=made).astype(np.int64)
        group = int(pdf["part"].iloc[0])
        return pdf.assign(sequence_id=base + (group << 31) + bins, offset=offsets, fill=fill[bins], bins=made, bound=bound)

    return pack


PACKED = PIECE_SCHEMA + ", part long, sequence_id long, offset long, fill long, bins long, bound long"


def _bound_of(pieces: DataFrame, capacity: int) -> int:
    """Bins that any packing of these pieces needs; what comes to the driver is a count for each length."""
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    by_length = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts:
        if r.length > capacity:
            raise ValueError("a piece is longer than a sequence")
        by_length[r.length] = r.n
    return _bound_of_counts(by_length, capacity)


def pack_pieces(pieces: DataFrame, capacity: int = 4096, items: int = 40_000, fullness: float = 0.995) -> DataFrame:
    """Give every piece a sequence and an offset; columns ``sequence_id, offset`` and the partition's certificate follow the piece's.

    ``items`` is about what one partition packs at once, doubled after each round that saves nothing, up to 16 times
    as much; ``fullness`` is the share of a bin above which it is left alone. Only numbers are shuffled, never texts or ids, and rows that repeat entirely are dealt apart. ``bins`` and
    ``bound`` are the partition's bins and certified least number in the round that placed the
    piece. Pieces longer than ``capacity`` are refused.
    """
    names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
    pool, least = pieces.select(*names), _bound_of(pieces, capacity)
    open_, gap = F.col("fill") < int(fullness * capacity), F.col("bins") > F.col("bound")
    bins_of = lambda df: df.select("sequence_id").distinct().count()
    done: list[DataFrame] = []
    full, base, round_, size = 0, 0, 0, items
    # sets of unfilled bins, as (bins, pieces as they are packed), that wait for the last exchange
    waiting: list[tuple[int, DataFrame]] = []
    before: tuple[int, DataFrame] | None = None  # how the pool was packed before the round
    all_in = True  # whether the pool has all unfilled bins
    while True:
        parts = max(1, -(-pool.count() // size))
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(round_)), F.lit(parts)))
        packed = materialize(dealt.groupBy("part").applyInPandas(_pack(capacity, base), PACKED), "packed")
        base, round_ = base + (parts << 31), round_ + 1
        gaps = (0, packed.limit(0))
        saved = before is None or bins_of(packed) < before[0]
        if saved:
            done.append(packed.filter(~open_))
            full += bins_of(done[-1])
            sure, gaps = ((bins_of(x), x) for x in (packed.filter(open_ & ~gap), packed.filter(open_ & gap)))
            waiting.append(sure)
        else:
            waiting.append(before)
            size *= 2
        if parts == 1:  # a pool of one partition would be packed in the same way again
            waiting, gaps = [*waiting, gaps], (0, gaps[1].limit(0))
        if not gaps[0] or gaps[0] <= _bound_of(gaps[1], capacity):
            waiting, gaps = [*waiting, gaps], (0, gaps[1].limit(0))
        if full + gaps[0] + sum(n for n, _ in waiting) <= least:
            break
        if gaps[0]:
            before, all_in = gaps, False
        else:
            union = waiting[0][1]
            for _, df in waiting[1:]:
                union = union.unionByName(df)
            whole = sum(n for n, _ in waiting), union
            if all_in and (parts == 1 or size > 16 * items) or whole[0] <= _bound_of(union, capacity):
                break
            waiting, before, all_in = [], whole, True
        pool = before[1].select(*names)
    out = done[0]
    for df in [*done[1:], *([gaps[1]] if gaps[0] else []), *(df for n, df in waiting if n)]:
        out = out.unionByName(df)
    return out.drop("part", "fill")


@tidied
def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int | None = 1) -> DataFrame:
    """Encode, cut and pack documents; one row a piece, placed gapless in its sequence.

    Null and empty texts are a sequence's single end id. Rows that repeat a ``doc_id`` or a whole
    row are packed each for itself. An empty table gives no rows.
    """
    pieces = materialize(token_pieces(docs, capacity, tokenizer, end_id), "pieces")
    return pack_pieces(pieces, capacity)


def sequences(packed: DataFrame, pieces_with_ids: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids`` (array of int), from pieces kept with their ids.

    A sequence gathers at most ``capacity`` ids, so no group grows with the data. Repeated rows
    share their ids, whichever of them is read.
    """
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = pieces_with_ids.dropDuplicates(keys).select(*[F.col(k).alias(f"_{k}") for k in keys], "ids")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = packed.join(ids, same, "left").select("sequence_id", "offset", "ids")
    parts = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u4").astype(np.int32) for parts in batch[1].to_pylist()]
            yield pa.record_batch([batch[0], pa.array(rows, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    return parts.mapInArrow(join_ids, "sequence_id long, ids array<int>")
