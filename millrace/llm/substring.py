"""Substring deduplication by level-wise doubling.

Windows of ``window`` words are told apart level by level. At the first level a window is judged by
a short run inside it, the one of least hash among its runs of ``seed`` words; runs that occur once
in the corpus rule their windows out. Windows left are judged at twice the length, and so on, until
the full length, or until no candidates survive. As equal windows choose the same run, no repeat is lost,
and only about one run in six is counted at the first level.

At the full length equal windows meet under their run's hash (64 bits of the run and 64 of the
window, from independent polynomials) and all but the first are marked. Windows that occur more than
once in a batch are settled there: a single one goes on, so a passage that many documents share
gives a reducer one row a batch. A run that very many windows share, as a common line in ever new
company does, does not gather them: its windows are dealt one by one under their own hash. Such runs
are told by a bitmap of fixed size, in which others may be included at no harm.

Runs and windows are told apart by hashes alone: 64 bits for a word and a run, 128 for a window. Reducers
get their rows in order and stream through them; what they hold is one key's windows of different hash.
Rows that repeat both doc_id and text are one document. Where very many do, one of them is judged and the
others get its result by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, text_or_empty, words

_LAST = (1 << 63) - 1  # stands for a null doc_id, which is after all others
# the bitmap of crowded runs has 2**20 places
_PLACES_LOG2 = 20
# odd multipliers of the two polynomials and of the mixing (parameters)
_RUN, _WHOLE, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def _polynomial(a: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of each run of ``length`` values, mod 2**64, mixed so that its order is random."""
    n = len(a) - length + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(length if n > 0 else 0):
        out = out * np.uint64(base) + (a[k : k + n] ^ np.uint64(base >> 7))
    out ^= out >> np.uint64(32)
    out *= np.uint64(_MIX)
    return out ^ (out >> np.uint64(29))


def _chosen_runs(a: np.ndarray, offsets: np.ndarray, seed: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the texts' words ``a``, cut at ``offsets``: run hashes, the starts of all windows, each one's run, and its text."""
    runs = _polynomial(a, seed, _RUN)
    lengths = np.diff(offsets)
    n = np.maximum(lengths - window + 1, 0)
    text = np.repeat(np.arange(len(lengths)), n)
    first = np.cumsum(n) - n
    starts = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(offsets[:-1], n)
    if not len(starts):
        return runs, starts, starts, text
    width, span = window - seed + 1, len(runs) - (window - seed)
    least = runs[:span].copy()
    for k in range(1, width):
        np.minimum(least, runs[k : k + span], out=least)
    at = np.zeros(span, dtype=np.int64)
    for k in range(width - 1, -1, -1):  # the leftmost of equals is set last
        at[runs[k : k + span] == least] = k
    return runs, starts, starts + at[starts], text


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    offsets = np.asarray(column.offsets)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with one row of each (doc, sub)."""
    doc, sub = (batch[k].to_numpy(zero_copy_only=False) for k in (0, 1))
    order = np.lexsort((sub, doc))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (sub[order][1:] != sub[order][:-1])
    return batch if new.all() else batch.take(pa.array(np.sort(order[new])))


def _emit_runs(seed: int, window: int, again: bool):
    """Map side of a level below the full length: the runs that still stand for windows.

    A row is (key, doc, sub, at, state): 0 to be counted, 1 known to repeat, 2 only tells that the
    key repeats, and in ``at`` how often. ``again``: a fourth column lists the runs of half the length that were found repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_once, batches):
            doc, sub = (batch[k].to_numpy(zero_copy_only=False) for k in (0, 1))
            a, offsets = _lists(batch[2])
            runs, starts, chosen, text = _chosen_runs(a.view(np.uint64), offsets, seed, window)
            if again:
                alive = _surviving(a.view(np.uint64), offsets, batch[3], seed // 2, window)
                chosen, text = chosen[alive], text[alive]
            fresh = np.ones(len(chosen), dtype=bool)
            fresh[1:] = chosen[1:] != chosen[:-1]
            chosen, text = chosen[fresh], text[fresh]
            key = runs[chosen]
            order = np.argsort(key, kind="stable")
            key, chosen, text = key[order], chosen[order], text[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            group = np.cumsum(new) - 1
            times = np.bincount(group)[group] if len(key) else group
            several = times > 1
            at = chosen - offsets[text]
            # known ones are dealt by their place, not by the key that all of them share
            spread = (key ^ (doc[text].view(np.uint64) * np.uint64(_WHOLE)) + at.astype(np.uint64)) * np.uint64(_MIX)
            tell = several & new
            cols = [
                np.concatenate((np.where(several, spread, key), key[tell])).view(np.int64),
                np.concatenate((doc[text], doc[text][tell])),
                np.concatenate((sub[text], sub[text][tell])),
                np.concatenate((at, times[tell])).astype(np.int32),
                np.concatenate((several.astype(np.int8), np.full(tell.sum(), 2, dtype=np.int8))),
            ]
            yield pa.record_batch([pa.array(c) for c in cols], names=["key", "doc", "sub", "at", "state"])

    return run


def _repeated(crowd: int):
    """Reduce side, rows in order of key: (doc, sub, at) of the runs whose key occurs twice or more, and rows with just ``place`` for keys that occur over ``crowd`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0  # the last key and how often it came so far
        held: np.ndarray | None = None  # its only row, while it may yet repeat
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, sub, at, state = (batch[k].to_numpy(zero_copy_only=False) for k in range(5))
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            group = np.cumsum(new) - 1
            times = np.bincount(group, weights=np.where(state == 2, at, state == 0)).astype(np.int64)
            goes_on = last is not None and key[0] == last
            if goes_on:
                times[0] += seen
            keep = (state == 1) | (state == 0) & (times > 1)[group]
            rows = [np.stack((doc[keep], sub[keep], at[keep]), axis=1)]
            if held is not None and goes_on and times[0] > 1:
                rows.append(held)
            still = held if goes_on and len(times) == 1 else None
            last, seen = key[-1], int(times[-1])
            own = np.flatnonzero((group == group[-1]) & (state == 0))
            held = None if seen != 1 else np.array([[doc[own[0]], sub[own[0]], at[own[0]]]], dtype=np.int64) if len(own) else still
            found = np.concatenate(rows)
            places = np.unique(_place(key[np.flatnonzero(new)][times > crowd].view(np.uint64)))
            kinds = (pa.int64(), pa.int64(), pa.int32())
            cols = [pa.concat_arrays([pa.array(found[:, k]).cast(t), pa.nulls(len(places), t)]) for k, t in enumerate(kinds)]
            yield pa.record_batch([*cols, pa.concat_arrays([pa.nulls(len(found), pa.int32()), pa.array(places, pa.int32())])], names=["doc", "sub", "at", "place"])

    return run


def _place(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - _PLACES_LOG2)).astype(np.int64)


def _surviving(a: np.ndarray, offsets: np.ndarray, repeated: pa.Array, seed: int, window: int) -> np.ndarray:
    """Which windows (in the order of ``_chosen_runs``) have a run among the texts' repeated ones."""
    _, _, chosen, _ = _chosen_runs(a, offsets, seed, window)
    values, ends = _lists(repeated)
    mark = np.zeros(len(a) + 1, dtype=bool)
    mark[values + np.repeat(offsets[:-1], np.diff(ends))] = True
    return mark[chosen]


def _emit_windows(seed: int, window: int, crowded: np.ndarray):
    """Map side of the full length: per run its surviving windows, as a mask of starts and their hashes.

    Row: (key, doc, sub, start, mask, known, hashes). ``known`` are windows that have an earlier
    equal in this batch; ``mask`` are those whose hashes follow. A window whose run is ``crowded``
    has a row of its own, under a key that tells its run and its own hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_once, batches):
            doc, sub = (batch[k].to_numpy(zero_copy_only=False) for k in (0, 1))
            a, offsets = _lists(batch[2])
            a = a.view(np.uint64)
            runs, starts, chosen, text = _chosen_runs(a, offsets, seed, window)
            alive = _surviving(a, offsets, batch[3], seed, window)
            starts, chosen, text = starts[alive], chosen[alive], text[alive]
            key, whole = runs[chosen], _polynomial(a, window, _WHOLE)[starts] if len(starts) else starts.astype(np.uint64)
            at = starts - offsets[text]
            known, sent = _settle(key, whole, doc[text], sub[text], at)
            alone = crowded[_place(key)]
            key = np.where(alone, (key ^ whole * np.uint64(_RUN)) * np.uint64(_MIX), key)
            # windows of one run are neighbours, so a row's starts lie within window - seed + 1
            row_new = alone.copy()
            row_new[:1] = True
            row_new[1:] |= chosen[1:] != chosen[:-1]
            row = np.cumsum(row_new) - 1
            first = np.flatnonzero(row_new)
            bit = np.int64(1) << (at - at[first][row] if len(first) else at)
            n = len(first)
            mask, settled = (np.zeros(n, dtype=np.int64) for _ in range(2))
            np.bitwise_or.at(mask, row[sent], bit[sent])
            np.bitwise_or.at(settled, row[known], bit[known])
            sizes = np.bincount(row[sent], minlength=n) if n else np.zeros(0, dtype=np.int64)
            spread = (key[first] ^ (doc[text[first]].view(np.uint64) * np.uint64(_WHOLE)) + at[first].astype(np.uint64)) * np.uint64(_MIX)
            cols = [
                pa.array(np.where(mask == 0, spread, key[first]).view(np.int64)), pa.array(doc[text[first]]), pa.array(sub[text[first]]), pa.array(at[first].astype(np.int32)),
                pa.array(mask), pa.array(settled), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(whole[sent].view(np.int64))),
            ]
            out = pa.record_batch(cols, names=["key", "doc", "sub", "start", "mask", "known", "hashes"])
            yield out.filter(pa.array((mask | settled) != 0))

    return run


def _settle(key: np.ndarray, whole: np.ndarray, doc: np.ndarray, sub: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have an earlier equal, and which are the first of their kind (one of them, where rows repeat)."""
    order = np.lexsort((at, sub, doc, whole, key))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (whole[order][1:] != whole[order][:-1])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    known, sent = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    known[order] = (doc[order] != doc[head]) | (sub[order] != sub[head]) | (at[order] != at[head])
    sent[order] = new
    return known, sent


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side, rows in order of key and place: (doc, sub, start, mask) of windows that have an earlier equal anywhere."""
    firsts = [np.zeros(0, dtype=np.int64)] * 5  # key, hash, doc, sub, start of the last key's different windows
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, sub, start, mask, known = (batch[k].to_numpy(zero_copy_only=False) for k in range(6))
        hashes, ends = _lists(batch[6])
        row = np.repeat(np.arange(len(key)), np.diff(ends))
        # the bits of a row's mask, in ascending order, are its hashes' windows
        rank = np.arange(len(row)) - ends[:-1][row]
        bit = np.zeros(len(row), dtype=np.int64)
        left = mask.copy()
        for k in range(int(rank.max()) + 1 if len(rank) else 0):
            low = left & -left
            here = rank == k
            bit[here] = low[row[here]]
            left &= left - 1
        shift = np.zeros(len(bit), dtype=np.int64)
        some = bit > 0
        shift[some] = np.round(np.log2(bit[some].astype(np.float64))).astype(np.int64)
        n = len(firsts[0])
        own = [np.concatenate(x) for x in zip(firsts, (key[row], hashes, doc[row], sub[row], start[row] + shift))]
        later, first = _settle(*own)
        kept = first & (own[0] == key[-1])
        firsts = [x[kept] for x in own]
        out = known.copy()
        np.bitwise_or.at(out, row[later[n:]], bit[later[n:]])
        keep = out != 0
        yield pa.record_batch([pa.array(c[keep]) for c in (doc, sub, start, out)], names=["doc", "sub", "start", "mask"])


def remove_repeats(docs: DataFrame, window: int = 20, seed: int = 10, id_col: str = "doc_id", text_col: str = "text", crowd: int = 1000) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by a space) of every row.

    A word goes if a window over it has an equal that starts earlier: in a smaller doc_id, or
    earlier in the same document. Windows are judged on the input. Null text has no words; a null
    doc_id is after all others; rows that share a doc_id are ordered by their text's hash, and rows
    that repeat entirely are one document with the same result for each. ``window`` must be
    ``seed`` times a power of two, and below ``seed + 63``. Runs that occur over ``crowd`` times have
    their windows dealt one by one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _cut_repeats(rows, "doc_id", "text", window, seed, crowd, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, window: int = 20, seed: int = 10, id_col: str = "doc_id", text_col: str = "text", crowd: int = 1000) -> DataFrame:
    """The documents with all their columns, their texts without the words that ``remove_repeats`` takes.

    A text that loses nothing, or is null, stays as it is; another is its kept words joined by a
    space, empty where all go. Rows stay, whatever is left of their text.
    """
    others = [c for c in docs.columns if c != text_col]
    out = _cut_repeats(docs, id_col, text_col, window, seed, crowd, keep_text=True)
    return out.select(*[F.col("kept_text").alias(c) if c == text_col else F.col(f"rest.c{others.index(c)}").alias(c) for c in docs.columns])


def _cut_repeats(docs: DataFrame, id_col: str, text_col: str, window: int, seed: int, crowd: int, keep_text: bool) -> DataFrame:
    """n_words, n_removed and kept_sha256 or kept_text, with the id column or, in ``rest``, all columns but the text."""
    levels = [seed]
    while levels[-1] < window:
        levels.append(2 * levels[-1])
    if levels[-1] != window or len(levels) < 2 or window - seed > 62:
        raise ValueError("window must be seed times a power of two, over one and within 62 words of the seed")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc")
    # positional names keep the columns that are carried along apart from ours
    carried = [F.col(c).alias(f"c{k}") for k, c in enumerate(c for c in docs.columns if c != text_col)] if keep_text else [F.col(id_col).alias("c0")]
    rest = F.struct(*carried, F.col(text_col).isNull().alias("none")).alias("rest")
    rows = docs.select(doc, text_or_empty(text_col).alias("text"), rest).withColumn("sub", F.xxhash64("text"))
    # rows that repeat are judged once; partial results leave one row of each a task, so copies do not gather. dealt
    # once for the last two steps, which read the same shuffle files
    dealt = rows.groupBy("doc", "sub").agg(F.first("text").alias("text"))
    hashed = F.transform(words("text"), lambda w: F.xxhash64(w))

    repeated = None
    for level in levels[:-1]:
        if repeated is None:
            # runs only say where to look, so copies may report them again
            source = rows.select("doc", "sub", hashed.alias("w"))
        else:
            source = _with_lists(dealt, repeated, "at", "inner").select("doc", "sub", hashed.alias("w"), "at")
        runs = source.mapInArrow(_emit_runs(level, window, repeated is not None), "key long, doc long, sub long, at int, state byte")
        counted = materialize(runs.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_repeated(crowd), "doc long, sub long, at int, place int"), "repeated-runs")
        repeated = counted.filter("place IS NULL").select("doc", "sub", "at")
    crowded = np.zeros(1 << _PLACES_LOG2, dtype=bool)
    for r in counted.filter("place IS NOT NULL").select("place").distinct().collect():  # at most 2**20
        crowded[r.place] = True
    windows = _with_lists(dealt, repeated, "at", "inner").select("doc", "sub", hashed.alias("w"), "at")
    windows = windows.mapInArrow(_emit_windows(levels[-2], window, crowded), "key long, doc long, sub long, start int, mask long, known long, hashes array<long>")
    later = windows.repartition(parts, "key").sortWithinPartitions("key", "doc", "sub", "start").mapInArrow(_later, "doc long, sub long, start int, mask long")
    marked = later.select("doc", "sub", F.struct("start", "mask").alias("place"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, removed, out = [], [], []
            for text, places in zip(batch[2].cast(pa.binary()).to_pylist(), batch[3].to_pylist()):
                own = text.split()
                kept = own
                if places:
                    gone = np.zeros(len(own) + 1, dtype=np.int64)
                    for place in places:
                        at, bits = place["start"], place["mask"]
                        while bits:
                            low = bits & -bits
                            k = at + low.bit_length() - 1
                            gone[k] += 1
                            gone[min(k + window, len(own))] -= 1
                            bits ^= low
                    keep = np.cumsum(gone)[:-1] == 0
                    kept = [w for w, k in zip(own, keep.tolist()) if k]
                n_words.append(len(own))
                removed.append(len(own) - len(kept))
                if keep_text:
                    out.append((text if len(kept) == len(own) else b" ".join(kept)).decode())
                else:
                    out.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            cols = [*batch.columns[:2], pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())]
            yield pa.record_batch(cols, names=["doc", "sub", "n_words", "n_removed", result])

    result = "kept_text" if keep_text else "kept_sha256"
    cuts = _with_lists(dealt, marked, "place", "left").select("doc", "sub", "text", "place").mapInArrow(cut, f"doc long, sub long, n_words long, n_removed long, {result} string")
    # an ordinary join, which can split the copies of one document
    found = rows.select("doc", "sub", "rest").join(cuts, ["doc", "sub"])
    if keep_text:
        return found.select("rest", F.when(~F.col("rest.none"), F.col(result)).alias(result))
    return found.select(F.col("rest.c0").alias("doc_id"), "n_words", "n_removed", result)


def _with_lists(dealt: DataFrame, places: DataFrame, column: str, how: str) -> DataFrame:
    """Join each text with the list of its places; a text's list is at most as long as the text."""
    lists = places.groupBy("doc", "sub").agg(F.collect_set(column).alias(column))
    return dealt.join(lists, ["doc", "sub"], how)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM d),
s AS (SELECT doc_id, k, array_to_string(words[k : k + 19], ' ') AS passage FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS k FROM d)),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY passage ORDER BY doc_id, k) AS place FROM s) WHERE place > 1),
m AS (SELECT w.doc_id, w.k, word, count(later.k) OVER (PARTITION BY w.doc_id ORDER BY w.k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM w LEFT JOIN later ON w.doc_id = later.doc_id AND w.k = later.k),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS g, string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(g, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
