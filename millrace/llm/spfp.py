"""Shortest-pack-first packing over the histogram of lengths.

Packs of one make are never handled one by one. The driver sees how many pieces have each length, places the lengths
from the longest to the shortest, always into the shortest packs so far, and keeps counts of packing patterns:
packs with equal contents are an interval of numbers, which a length fills whole or splits in two. What comes out
is a plan of placements ("pieces r to r + n of length l lie in packs p to p + n at this offset"), whose size depends on the
capacity and not on the corpus. Pieces are ranked within their length by Spark and look their rank up in the plan.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, tidied
from .tokens import default_path, encoder

#: Bits of a rank within its length in the keys of the plan.
_RANK_BITS = 48


@dataclass
class Plan:
    """Placements in columns, and the patterns with their counts.

    Placement j: the ``count[j]`` pieces of ``length[j]`` from rank ``rank[j]`` on lie one each in the packs
    from ``pack[j]`` on, at ``offset[j]``.
    """

    capacity: int
    packs: int = 0
    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    pack: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    #: (packs, ((length, times), ...) from the longest) for each pattern
    patterns: list[tuple[int, tuple[tuple[int, int], ...]]] = field(default_factory=list)

    def _put(self, *placement: int) -> None:
        for column, value in zip((self.length, self.rank, self.pack, self.count, self.offset), placement):
            column.append(value)


def shortest_pack_first(histogram: np.ndarray, capacity: int) -> Plan:
    """Place ``histogram[l]`` pieces of every length l up to ``capacity``.

    A piece goes to the shortest pack in which it fits, else into a new one; where the shortest has no room no other has.
    Equal packs take equal pieces in one step, so the work depends on lengths and patterns, not on pieces.
    """
    plan = Plan(capacity)
    # open packs by fill: intervals of pack numbers with their pattern, a chain of (pattern before, length, times)
    by_fill: dict[int, list[tuple[int, int, tuple | None]]] = {}
    fills: list[int] = []

    def keep(fill: int, first: int, count: int, pattern: tuple | None) -> None:
        if fill not in by_fill:
            by_fill[fill] = []
            heapq.heappush(fills, fill)
        by_fill[fill].append((first, count, pattern))

    for length in range(len(histogram) - 1, 0, -1):
        left, rank = int(histogram[length]), 0
        if left and length > capacity:
            raise ValueError("a piece is longer than a sequence")
        while left:
            if fills and fills[0] + length <= capacity:
                fill = fills[0]
                first, count, pattern = by_fill[fill].pop()
                taken = min(count, left)
                plan._put(length, rank, first, taken, fill)
                rank, left = rank + taken, left - taken
                if count > taken:  # the pattern's count is split
                    by_fill[fill].append((first + taken, count - taken, pattern))
                if not by_fill[fill]:
                    del by_fill[heapq.heappop(fills)]
                keep(fill + length, first, taken, (pattern, length, 1))
                continue
            # a new pack is the shortest until it has no room for this length
            each = capacity // length
            for packs, times in ((left // each, each), (1, left % each)):
                if packs and times:
                    for k in range(times):
                        plan._put(length, rank, plan.packs, packs, k * length)
                        rank += packs
                    keep(times * length, plan.packs, packs, (None, length, times))
                    plan.packs += packs
            left = 0
    counts: Counter[tuple] = Counter()
    for groups in by_fill.values():
        for _, count, pattern in groups:
            times: Counter[int] = Counter()
            while pattern:
                times[pattern[1]] += pattern[2]
                pattern = pattern[0]
            counts[tuple(sorted(times.items(), reverse=True))] += count
    plan.patterns = [(n, p) for p, n in sorted(counts.items(), reverse=True)]
    return plan


def ranked_pieces(docs: DataFrame, capacity: int, tokenizer: str | None = None, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of whole texts: ``doc_id, start, length, ids_crc32, doc_tokens, part, k``.

    Only what is longer than ``capacity`` is cut, into full pieces and a rest. ``k`` counts the pieces of one
    length in their task from 0, and ``part`` is the task: they hold for the table that this is written to once. With ``keep_ids``
    the ids follow as little-endian unsigned 32-bit bytes. Narrow.
    """
    tokenizer = tokenizer or default_path("word_bpe_49k.json")
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    width = 4 * capacity
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "k", *(["ids"] if keep_ids else [])]
    kinds = dict.fromkeys(names, pa.int64()) | {"ids": pa.binary()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(tokenizer).encode, Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                ids = encode(text) + end
                for at in range(0, len(ids), width):
                    piece = ids[at : at + width]
                    n = len(piece) // 4
                    rows.append((doc_id, at // 4, n, zlib.crc32(piece), len(ids) // 4, part, seen[n], piece)[: len(names)])
                    seen[n] += 1
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, kinds[x]) for c, x in zip(columns, names)], names=names)

    schema = ", ".join(f"{x} {'binary' if x == 'ids' else 'long'}" for x in names)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(cut, schema)


def plan_of(counts: DataFrame, capacity: int) -> Plan:
    """The plan for pieces counted by ``length, part, n``; the driver gets one number a length."""
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        if r.length > capacity:
            raise ValueError("a piece is longer than a sequence")
        histogram[r.length] = r.n
    return shortest_pack_first(histogram, capacity)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of ``ranked_pieces``.

    A piece's rank within its length is its ``k`` plus the pieces of that length in the tasks before. Only
    numbers are shuffled, by (task, length), so that no length gathers anywhere; a length's own window runs over a row a task. What goes to the
    tasks is the plan, some tens of thousands of numbers at most for 2,048 tokens.
    """
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "length-counts")
    plan = plan_of(counts, capacity)
    key, start = np.array(plan.length, dtype=np.int64) << _RANK_BITS, np.array(plan.rank, dtype=np.int64)
    order = np.argsort(key + start, kind="stable")
    columns = [(key + start)[order], start[order], np.array(plan.pack, dtype=np.int64)[order], np.array(plan.offset, dtype=np.int64)[order]]
    sent = pieces.sparkSession.sparkContext.broadcast(columns)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = [c for c in pieces.columns if c not in ("part", "k")]
    # positional names keep the columns that are carried along apart from ours
    ranked = pieces.select("part", "length", "k", *[F.col(c).alias(f"c{j}") for j, c in enumerate(names)]).join(bases, ["part", "length"])
    ranked = ranked.select(*[f"c{j}" for j in range(len(names))], "length", (F.col("base") + F.col("k")).alias("rank"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, starts, packs, offsets = sent.value
        for batch in batches:
            rank = batch["rank"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (batch["length"].to_numpy(zero_copy_only=False) << _RANK_BITS) + rank, side="right") - 1
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(packs[at] + rank - starts[at]), pa.array(offsets[at])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (pieces.schema[c] for c in names))
    return ranked.mapInArrow(look_up, schema + ", sequence_id long, offset long")


@tidied
def pack_by_histogram(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int | None = 1) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are a single end id (no piece if there is none). Rows that repeat a doc_id or a whole row are
    packed each for itself. Which of equally long pieces gets which place is a matter of the tasks they are read
    in; how many packs of which pattern there are is not. An empty table gives no rows.
    """
    pieces = materialize(ranked_pieces(docs, capacity, tokenizer, end_id), "ranked-pieces")
    return place(pieces, capacity)


def packed_ids(placed: DataFrame) -> DataFrame:
    """The sequences themselves, ``sequence_id, ids`` (array of int), from placed pieces that kept their ids; each has at most the capacity."""
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u4").astype(np.int32) for parts in batch[1].to_pylist()]
            yield pa.record_batch([batch[0], pa.array(rows, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    return parts.mapInArrow(join_ids, "sequence_id long, ids array<int>")
