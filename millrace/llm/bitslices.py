"""Hard negatives by bit-sliced integer products.

Vectors become integers, and a candidate's components are read one bit-plane at a time, the most significant first. After
the planes down to bit r an anchor's product with a candidate is known but for the lower bits, which add
between 2**r - 1 times the sum of the anchor's negative components and as much of its positive ones. A candidate is dropped as soon
as that interval misses every range of scores that is still asked for, or ends below the k-th best so far; what is left after the last plane has its exact score.

Anchors are taken in passes of bounded size; every pass compares them with all rows, tile by tile, where the rows are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import best_of_each, materialize, tidied

#: Components as large as this in size would let products leave 64 bits.
_LARGEST = 1 << 24
_NEVER = 1 << 62


def quantized(vectors: DataFrame, scale: float = 256.0, relabel: int = 7, labels: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows that take part: ``vec_id, label, q`` with q = floor(scale * x) for each component.

    Rows with a null label, a null vector, or a null or non-finite component take no part, nor do those whose q has a component of
    2**24 and more in size, whose products may not fit 64 bits. Where vec_id is divisible by ``relabel`` the label moves on by one, modulo ``labels``.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fits = lambda x: F.coalesce(~F.isnan(x) & (F.abs(F.floor(x * scale)) < _LARGEST) & (F.abs(x) < _LARGEST), F.lit(False))
    moved = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.filter("label IS NOT NULL AND v IS NOT NULL").filter(F.forall("v", fits)).select("vec_id", moved.alias("label"), F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("q"))


@dataclass
class Anchors:
    """A block of anchors with what is asked for each: the best ``k`` scores in each of its ranges [low, high].

    Without ``same`` candidates have another label than the anchor, with it the same one, and are other rows.
    """

    row: np.ndarray
    label: np.ndarray
    q: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int
    same: bool
    #: what was found, in order of (range, score descending, null ids last, id); range t of anchor a is a * ranges + t
    found: tuple[np.ndarray, ...] = field(default_factory=lambda: tuple(np.zeros(0, dtype=np.int64) for _ in range(4)))
    #: pairs whose planes were read, for each plane read one pair at a time
    pairs_read: int = 0

    def __post_init__(self):
        self.least = self.low.copy()

    def take(self, ranges: np.ndarray, score: np.ndarray, null: np.ndarray, vec_id: np.ndarray) -> None:
        """Keep the best k of each range."""
        all_ = [np.concatenate(x) for x in zip(self.found, (ranges, score, null, vec_id))]
        order = np.lexsort((all_[3], all_[2], -all_[1], all_[0]))
        all_ = [x[order] for x in all_]
        place = _places(all_[0])
        self.found = tuple(x[place < self.k] for x in all_)
        last = all_[0][place == self.k - 1]
        self.least.reshape(-1)[last] = np.maximum(self.low.reshape(-1)[last], all_[1][place == self.k - 1])


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of each entry of a sorted array among its equals."""
    at = np.arange(len(groups))
    starts = np.r_[True, groups[1:] != groups[:-1]] if len(groups) else np.zeros(0, dtype=bool)
    return at - np.maximum.accumulate(np.where(starts, at, 0)) if len(at) else at


def search_tile(anchors: Anchors, row: np.ndarray, vec_id: np.ndarray, null: np.ndarray, label: np.ndarray, q: np.ndarray, bits: int, share: float = 1 / 16) -> None:
    """Compare a block of anchors with a tile of rows, plane by plane.

    While more than ``share`` of the pairs are alive a plane is a matrix product, then it is read for the pairs that are left.
    """
    a, width = anchors.q, anchors.low.shape[1]
    # sums are exact: in 24 bits for a plane, in 53 for scores, else in 64
    wide = int(np.abs(a).sum(axis=1).max(initial=0)) << bits
    kind = np.float64 if wide < 1 << 52 else np.int64
    plane_kind = np.float32 if wide >> bits < 1 << 24 else kind
    down, up = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
    shifted = q + (1 << (bits - 1))  # not negative, so that every plane adds
    alive = anchors.label[:, None] == label
    if anchors.same:
        alive &= anchors.row[:, None] != row
    else:
        np.logical_not(alive, out=alive)
    partial = np.repeat((-(1 << (bits - 1)) * a.sum(axis=1)).astype(kind)[:, None], len(row), axis=1)
    left, dense = a.astype(plane_kind), True
    i = j = score = np.zeros(0, dtype=np.int64)
    for r in range(bits - 1, -1, -1):
        rest = (1 << r) - 1
        if dense:
            partial += (left @ ((shifted >> r) & 1).astype(plane_kind).T).astype(kind, copy=False) * kind(1 << r)
            low_end, high_end = (anchors.least.min(axis=1) - rest * up).astype(kind), (anchors.high.max(axis=1) - rest * down).astype(kind)
            alive &= (partial >= low_end[:, None]) & (partial <= high_end[:, None])
            n = np.count_nonzero(alive)
            if n > share * alive.size and r:
                continue
            dense = False
            i, j = np.nonzero(alive)
            score = partial[i, j].astype(np.int64)
        else:
            anchors.pairs_read += len(i)
            score = score + (np.einsum("pd,pd->p", a[i], (shifted[j] >> r) & 1) << r)
        if not len(i):
            return
        # by range: a pair stays if it can be in it and above its k-th
        lower, upper = score + rest * down[i], score + rest * up[i]
        asked = (upper[:, None] >= anchors.least[i]) & (lower[:, None] <= anchors.high[i])
        pair, t = np.nonzero(asked)
        own = i[pair] * width + t
        if r:
            # the k-th of the lower ends that are sure to lie in the range
            sure = (lower[pair] >= anchors.low[i[pair], t]) & (upper[pair] <= anchors.high[i[pair], t])
            group, end = own[sure], lower[pair[sure]]
            order = np.lexsort((-end, group))
            group, end = group[order], end[order]
            kth = _places(group) == anchors.k - 1
            least = anchors.least.reshape(-1)
            least[group[kth]] = np.maximum(least[group[kth]], end[kth])
            stays = np.zeros(len(i), dtype=bool)
            stays[pair[upper[pair] >= least[own]]] = True
            i, j, score = i[stays], j[stays], score[stays]
        else:
            anchors.take(own, score[pair], null[j[pair]], vec_id[j[pair]])


def _dense(lists: pa.ListArray, dimension: int) -> np.ndarray:
    """Rows of components, shorter ones padded with zeros."""
    values, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dimension), dtype=np.int64)
    out[np.arange(dimension) < sizes[:, None]] = values
    return out


def _compare(rows: DataFrame, blocks: list[Anchors], dimension: int, bits: int, tile: int) -> DataFrame:
    """``anchor`` (number in the pass), ``t`` (range), ``score, vec_id``: the best k of each range in each task's rows."""
    sent = rows.sparkSession.sparkContext.broadcast(blocks)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Anchors(b.row, b.label, b.q, b.low, b.high, b.k, b.same) for b in sent.value]
        for batch in batches:
            for at in range(0, batch.num_rows, tile):
                part = batch.slice(at, tile)
                vec_id = part["vec_id"].fill_null(0).to_numpy(zero_copy_only=False)
                null = part["vec_id"].is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                columns = (part["row"].to_numpy(zero_copy_only=False), vec_id, null, part["label"].to_numpy(zero_copy_only=False), _dense(part["q"], dimension))
                for block in own:
                    search_tile(block, *columns, bits)
        first = 0
        for block in own:
            ranges, score, null, vec_id = block.found
            width = block.low.shape[1]
            yield pa.record_batch([pa.array(first + ranges // width), pa.array(ranges % width), pa.array(score), pa.array(vec_id, mask=null.astype(bool))], names=["anchor", "t", "score", "vec_id"])
            first += len(block.row)

    return rows.mapInArrow(compare, "anchor long, t long, score long, vec_id long")


@tidied
def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, every: int = 100, anchors_per_pass: int = 8192, tile: int = 4096, block: int = 256, **columns) -> DataFrame:
    """Per anchor (vec_id divisible by ``every``) and positive its hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the first ``positives`` other rows of its label; its negatives for one of them the first ``negatives`` rows of other labels
    whose score is from ``least`` to ``most`` per cent of the positive's. Scores are integer inner products, highest first, ties by smaller vec_id, null last.
    See ``quantized`` for the rows that take part. Rows that repeat are rows of their own, as anchors (each with its rows in the result) and as candidates;
    shorter vectors count as padded with zeros; anchors without positives, and positives without negatives, have no rows, nor has an empty table.
    What goes to the driver and the tasks at once is a pass's ``anchors_per_pass`` anchors (about as many, as they are dealt by hash) and their positives.
    """
    rows = materialize(quantized(vectors, **columns).withColumn("row", F.monotonically_increasing_id()), "quantized")
    sizes = rows.agg(F.max(F.size("q")).alias("dimension"), F.max(F.array_max(F.transform("q", F.abs))).alias("largest"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    dimension, bits, passes = sizes.dimension or 0, 1 + (sizes.largest or 0).bit_length(), max(1, -(-sizes.anchors // anchors_per_pass))
    out = None
    for p in range(passes):
        chosen = rows.filter((F.col("vec_id") % every == 0) & (F.pmod(F.xxhash64("row"), F.lit(passes)) == p)).toArrow()
        row, anchor_id, label = (chosen[c].to_numpy() for c in ("row", "vec_id", "label"))
        q = _dense(chosen["q"].combine_chunks(), dimension) if len(row) else np.zeros((0, dimension), dtype=np.int64)
        cuts = [slice(at, at + block) for at in range(0, len(row), block)]
        everything = np.full((len(row), 1), _NEVER)
        found = _compare(rows, [Anchors(row[c], label[c], q[c], -everything[c], everything[c], positives, True) for c in cuts], dimension, bits, tile)
        order = lambda: [F.desc("score"), F.asc_nulls_last("vec_id")]
        mates = best_of_each(found, ["anchor"], order(), positives).select("anchor", "rank", "score", "vec_id").toArrow().to_pydict()
        scores, ids = np.full((len(row), positives), -1, dtype=np.int64), np.full((len(row), positives), None, dtype=object)
        there = np.array(mates["anchor"], dtype=np.int64), np.array(mates["rank"], dtype=np.int64) - 1
        scores[there], ids[there] = np.array(mates["score"], dtype=np.int64), np.array(mates["vec_id"], dtype=object)
        # no score is in the range of a negative or missing positive
        low, high = np.where(scores >= 0, -(-least * scores // 100), _NEVER), np.where(scores >= 0, most * scores // 100, -_NEVER)
        own = _compare(rows, [Anchors(row[c], label[c], q[c], low[c], high[c], negatives, False) for c in cuts], dimension, bits, tile)
        ranked = best_of_each(own, ["anchor", "t"], order(), negatives)
        sent = rows.sparkSession.sparkContext.broadcast((anchor_id, ids, scores))

        def named(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            anchor_ids, positive_ids, positive_scores = sent.value
            for batch in batches:
                a, t = batch["anchor"].to_numpy(), batch["t"].to_numpy()
                yield pa.record_batch([pa.array(anchor_ids[a]), pa.array(positive_ids[a, t].tolist(), pa.int64()), batch["rank"], batch["vec_id"], pa.array(positive_scores[a, t]), batch["score"]], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        part = ranked.select("anchor", "t", "rank", "vec_id", "score").mapInArrow(named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        out = part if out is None else out.unionByName(part)
    return out


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id AS other_id, a.label = e.label AS same, list_dot_product(a.q, e.q)::BIGINT AS score
  FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM s WHERE same),
n AS (
  SELECT anchor_id, positive_id, positive_score, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE p.place <= 5 AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
