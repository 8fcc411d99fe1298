"""Benchmark decontamination by greedy string tiling.

Texts are compared as sequences of lower-cased words, punctuation left out. A document and an item
that share a seed, a run of ``min_match`` words, are tiled: the longest runs that both have and
that no tile covers yet are marked, again and again, found by running Karp-Rabin over run lengths
that shrink to ``min_match``. Order plays no part, so passages that were reordered are covered
piece by piece. A pair counts as contaminated if tiles cover enough of the item.

Documents are read once for each block of items with some eight million seeds. A Bloom filter of a block's seeds, of 16 bits a seed and 16 MB at
most, goes to every task; of a document only the stretches under seeds that pass it are kept, which is all that tiles can
cover. Equal stretches and equal items are tiled once, and the rows that have them are joined to the result. Seeds are joined. An item offers only its rarest seeds for that, just so many that the others
cover too little of it: a contaminated document has one of them. So a seed that very many documents and
items share makes pairs only where nothing rarer can.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, result, scratch, text_key, text_or_empty, tidied

_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bits of the Bloom filter of seeds at most, as a power of two, bits for each seed, also so, and how many of them are set for one.
_BLOOM_LOG2, _BITS_LOG2, _BLOOM_HASHES = 27, 4, 3


def tokens(text: Column | str) -> Column:
    """64-bit hashes of a text's lower-cased runs of letters and digits."""
    found = F.filter(F.split(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


class _Hashes:
    """Karp-Rabin hashes of all runs of an array, of any length, from running sums mod 2**64."""

    def __init__(self, a: np.ndarray):
        n = len(a)
        # an odd base has an inverse, so a run's sum is moved to where it would begin
        up, down = (np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, x, dtype=np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(a * up[:n], dtype=np.uint64)))
        self.down = down

    def runs(self, length: int) -> np.ndarray:
        n = max(len(self.sums) - length, 0)
        out = (self.sums[length:] - self.sums[:n]) * self.down[:n]
        return (out ^ (out >> np.uint64(31))) * np.uint64(_MIX)


def _seed_hashes(a: np.ndarray, length: int) -> np.ndarray:
    """The same hashes of one short length."""
    n = max(len(a) - length + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(length - 1, -1, -1) if n else ():
        out = out * np.uint64(_BASE) + a[k : k + n]
    return (out ^ (out >> np.uint64(31))) * np.uint64(_MIX)


def _free_runs(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of the runs of ``length`` tokens without a marked one."""
    total = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(total[length:] == total[:-length]) if len(marked) >= length else np.zeros(0, dtype=np.int64)


def greedy_tiles(text: np.ndarray, item: np.ndarray, min_match: int, closed: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (start in text, start in item, length), none overlapping, longest first.

    Of matches of equal length the one that starts earliest in the item, then in the text, is marked.
    ``closed`` marks places of the text that no tile may cover. The longest length left is found by
    halving, with all runs of a length hashed at once; as the tiles of different lengths add up to the
    item at most, the lengths are few, however often words repeat.
    """
    in_text = np.zeros(len(text), dtype=bool) if closed is None else closed.copy()
    in_item = np.zeros(len(item), dtype=bool)
    hashes, wanted = _Hashes(text), _Hashes(item)

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts in item and text of free runs that both have, and all hashes."""
        a, b = hashes.runs(length), wanted.runs(length)
        free, item_free = _free_runs(in_text, length), _free_runs(in_item, length)
        own = item_free[np.isin(b[item_free], a[free])]
        return own, free[np.isin(a[free], b[own])], a, b

    out: list[tuple[int, int, int]] = []
    most = min(len(text), len(item))
    while most >= min_match:
        low, high = min_match - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        if low < min_match:
            break
        starts, places, a, b = common(low)
        where: dict[int, list[int]] = {}
        for t in places[::-1].tolist():
            where.setdefault(int(a[t]), []).append(t)
        for i in starts.tolist():
            if in_item[i : i + low].any():
                continue
            left = where.get(int(b[i]), [])
            while left and in_text[left[-1] : left[-1] + low].any():
                left.pop()
            if left and (text[left[-1] : left[-1] + low] == item[i : i + low]).all():
                t = left.pop()
                in_text[t : t + low] = in_item[i : i + low] = True
                out.append((t, i, low))
        most = low - 1
    return out


def covered(n: int, starts: np.ndarray, length: int) -> int:
    """Places of ``n`` that runs of a length at these starts cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def _bloom_places(k: int, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """Which of ``2**bits`` bits are the ``k``-th that stand for hashes."""
    return lambda hashes: ((hashes * np.uint64(2 * k + 0x9E3779B1)) >> np.uint64(64 - bits)).astype(np.int64)


def _bloom(seeds: DataFrame, bits: int) -> np.ndarray:
    """The filter's bits as bytes, put together from pieces of 4 KB in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch[0].to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.record_batch([pa.array(np.unique(np.concatenate([_bloom_places(k, bits)(hashes) for k in range(_BLOOM_HASHES)])))], names=["bit"])

    places = seeds.select("h").mapInArrow(run, "bit long")
    # buckets begin at 1 and hold 32,768 numbers from 1 on
    pieces = places.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits")).collect()
    out = np.zeros((1 << bits - 15, 1 << 12), dtype=np.uint8)
    for r in pieces:  # at most 2**(bits - 15) rows
        out[r.piece - 1] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out.ravel()


def _item_seeds(items: DataFrame, min_match: int) -> DataFrame:
    """h, item, at: the seeds of items and where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, t in zip(batch[0].to_pylist(), batch[1]):
                h = _seed_hashes(np.asarray(t.values.to_numpy(zero_copy_only=False)).view(np.uint64), min_match)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.full(len(h), item)), pa.array(np.arange(len(h), dtype=np.int32))], names=["h", "item", "at"])

    return items.select("item", "t").mapInArrow(run, "h long, item long, at int")


def _stretches(rows: DataFrame, bloom: np.ndarray, bits: int, min_match: int) -> DataFrame:
    """doc_id, the text's key t0, t1, words and ends: of each document its stretches under seeds that pass the filter, if any; ``ends`` cuts the words into these."""
    shared = rows.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            offsets = np.asarray(batch[3].offsets)
            values = batch[3].values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
            offsets = (offsets - offsets[0]).astype(np.int64)
            hashes = _seed_hashes(values, min_match)
            at = np.arange(len(hashes))
            for k in range(_BLOOM_HASHES):
                place = _bloom_places(k, bits)(hashes[at])
                at = at[(held[place >> 3] >> (place & 7) & 1).astype(bool)]
            text = np.searchsorted(offsets, at, side="right") - 1
            inside = at + min_match <= offsets[text + 1]
            at, text = at[inside], text[inside]
            if not len(at):
                continue
            # a stretch goes on while the next seed begins inside it or where it ends
            new = np.ones(len(at), dtype=bool)
            new[1:] = (at[1:] > at[:-1] + min_match) | (text[1:] != text[:-1])
            last = np.append(new[1:], True)
            begin, end, owner = at[new], at[last] + min_match, text[new]
            size = end - begin
            index = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
            docs, first = np.unique(owner, return_index=True)
            bounds = np.append(first, len(owner)).astype(np.int32)
            total = np.concatenate(([0], np.cumsum(size)))
            ends = total[1:] - np.repeat(total[bounds[:-1]], np.diff(bounds))
            cols = [*(c.take(pa.array(docs)) for c in batch.columns[:3]), pa.ListArray.from_arrays(pa.array(total[bounds].astype(np.int32)), pa.array(values[index].view(np.int64))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ends.astype(np.int32)))]
            yield pa.record_batch(cols, names=["doc_id", "t0", "t1", "words", "ends"])

    return rows.mapInArrow(run, "doc_id long, t0 long, t1 long, words array<long>, ends array<int>")


def _closed_words(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches one after the other, each followed by a place that is closed; and which places are."""
    at = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)) + np.arange(len(words))
    out, closed = np.zeros(len(words) + len(ends), dtype=np.uint64), np.ones(len(words) + len(ends), dtype=bool)
    out[at], closed[at] = words.view(np.uint64), False
    return out, closed


def _numbers(column: pa.ListScalar | None) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)


@tidied
def overlaps(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_tokens (of the item), n_matched, n_tiles and coverage of contaminated pairs.

    A pair is contaminated if tiles of ``min_match`` words or more cover at least the share
    ``coverage`` (over 0) of the item. Items with fewer than ``min_match`` words, null and empty texts match
    nothing. Whole texts are read once. Repeated rows on either side each give their pairs. Words
    and seeds are told apart by 64-bit hashes.
    """
    return _contaminated(docs, benchmark, min_match, coverage, id_col, text_col, item_id_col, item_text_col).drop("t0", "t1")


def _contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int, coverage: float, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", seeds_per_pass: int = 1 << 23) -> DataFrame:
    """The rows of ``overlaps`` with the key t0, t1 of the document's text."""
    asked = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), tokens(item_text_col).alias("t"))
    asked = materialize(asked.withColumn("item", F.xxhash64("t")), "benchmark")
    # equal items are one; a text's hash numbers it
    items = materialize(asked.groupBy("item").agg(F.first("t").alias("t")), "distinct-items")
    total = items.agg(F.sum(F.greatest(F.size("t") - min_match + 1, F.lit(0))).alias("n")).first().n or 0
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_key(text_col), tokens(text_col).alias("t"))
    blocks = max(1, -(-total // seeds_per_pass))
    out = None
    for k in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        found = _tiled(rows, own, min_match, coverage, max(16, min(_BLOOM_LOG2, ((total // blocks) << _BITS_LOG2).bit_length())))
        out = found if out is None else out.unionByName(found)
    # the rows that have an item's text
    return out.join(asked.select("item", "item_id"), "item").drop("item")


def _tiled(rows: DataFrame, items: DataFrame, min_match: int, coverage: float, bits: int, pairs_per_task: int = 2000) -> DataFrame:
    """The contaminated pairs of rows and different items, those of a block."""
    seeds = materialize(_item_seeds(items, min_match), "benchmark-seeds")
    seeded = _stretches(rows, _bloom(seeds, bits), bits, min_match)
    # 128 bits stand for what is left of a document
    key = [F.xxhash64("words", "ends").alias("doc"), F.xxhash64("words", "ends", F.lit("s1")).alias("s1")]
    holders = materialize(seeded.select("doc_id", "t0", "t1", "words", "ends", *key), "seeded-documents")
    found = materialize(holders.groupBy("doc", "s1").agg(F.first("words").alias("words"), F.first("ends").alias("ends")), "distinct-stretches")

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, s1, w, e in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2], batch[3]):
                words, closed = _closed_words(_numbers(w), _numbers(e))
                own = np.unique(_seed_hashes(words, min_match)[_free_runs(closed, min_match)])
                yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(np.full(len(own), doc)), pa.array(np.full(len(own), s1))], names=["h", "doc", "s1"])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of an item's seeds that documents have, those without which less than ``coverage`` of it is left."""
        for batch in batches:
            for item, n, own in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2].to_pylist()):
                places: dict[int, list[int]] = {}
                for s in own:
                    places.setdefault(s["h"], []).append(s["at"])
                often = [h for _, h in sorted({(s["n"], s["h"]) for s in own}, reverse=True)]
                # the most frequent ones are left out, as many as cover too little without the others
                low, high = 0, len(often)
                while low < high:
                    middle = (low + high + 1) // 2
                    left = np.array([at for h in often[:middle] for at in places[h]], dtype=np.int64)
                    low, high = (middle, high) if covered(n, left, min_match) < coverage * n else (low, middle - 1)
                offered = often[low:]
                yield pa.record_batch([pa.array(offered, pa.int64()), pa.array([item] * len(offered), pa.int64())], names=["h", "item"])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, s1, item_id, w, e, t in zip(*(c.to_pylist() for c in batch.columns[:3]), *batch.columns[3:]):
                item = _numbers(t).view(np.uint64)
                words, closed = _closed_words(_numbers(w), _numbers(e))
                # what the pair's own seeds do not cover, no tile does
                own = _seed_hashes(item, min_match)
                starts = _free_runs(closed, min_match)
                if covered(len(item), np.flatnonzero(np.isin(own, _seed_hashes(words, min_match)[starts])), min_match) < coverage * len(item):
                    continue
                tiles = greedy_tiles(words, item, min_match, closed)
                matched = sum(n for _, _, n in tiles)
                if matched >= coverage * len(item):
                    out.append((doc, s1, item_id, len(item), matched, len(tiles), matched / len(item)))
            kinds = [pa.int64()] * 6 + [pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 7, kinds)], names=["doc", "s1", "item", "n_tokens", "n_matched", "n_tiles", "coverage"])

    hits = materialize(found.select("doc", "s1", "words", "ends").mapInArrow(doc_seeds, "h long, doc long, s1 long"), "document-seeds")
    often = hits.groupBy("h").agg(F.count("*").alias("n"))
    met = seeds.join(often, "h").groupBy("item").agg(F.collect_list(F.struct("h", "at", "n")).alias("own"))
    offered = materialize(met.join(items.select("item", F.size("t").alias("size")), "item").select("item", "size", "own").mapInArrow(rarest, "h long, item long"), "offered-seeds")
    pairs = materialize(hits.join(offered, "h").select("doc", "s1", "item").distinct(), "seeded-pairs")
    both = pairs.join(items, "item").join(found, ["doc", "s1"]).select("doc", "s1", "item", "words", "ends", "t")
    # by their number, as the work is one of pairs and not of bytes
    dealt = both.repartition(max(1, -(-pairs.count() // pairs_per_task)))
    tiled = materialize(dealt.mapInArrow(tile, "doc long, s1 long, item long, n_tokens long, n_matched long, n_tiles long, coverage double"), "tiled-pairs")
    return holders.select("doc_id", "t0", "t1", "doc", "s1").join(tiled, ["doc", "s1"]).drop("doc", "s1")


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    What holds one is told by doc_id and text, so rows without a doc_id go as well, and so do all rows that repeat a contaminated
    one. Null and empty texts hold nothing and stay, an empty benchmark keeps every row, and an empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        hits = result(_contaminated(docs, benchmark, min_match, coverage).select("doc_id", "t0", "t1").distinct(), "contaminated")
    # positional names keep the columns that are carried along apart from ours
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key("text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    same = rows["doc_id"].eqNullSafe(hits["doc_id"]) & (rows["t0"] == hits["t0"]) & (rows["t1"] == hits["t1"])
    return rows.join(hits, same, "left_anti").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
