"""Toxicity: a factorization machine over hashed terms.

A text is the set of its terms, hashed to buckets: its lower-cased words, the stems (first letters) of
its longer words, and the stems that two or more of its different words share. Its score is the sigmoid of a bias,
a weight a term, and the inner product of two terms' factors for every pair of terms, so that terms
count together that are harmless alone. Pairs cost no more than terms: half of the squared sum
less the sum of squares, factor by factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

#: Buckets of each of the three kinds of term, and the letters of a stem.
BUCKETS, STEM = 1 << 21, 5


def hashed_terms(text: Column | str) -> Column:
    """A struct of ``words`` and ``stems``: buckets of a whole text's different words, runs of letters and digits, and of their stems."""
    found = F.array_distinct(F.filter(F.split(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    both = F.transform(found, lambda w: F.struct(bucket(w).alias("w"), F.when(F.char_length(w) > STEM, bucket(F.substring(w, 1, STEM))).alias("s")))
    return F.get(F.transform(F.array(both), lambda t: F.struct(t["w"].alias("words"), F.filter(t["s"], lambda x: x.isNotNull()).alias("stems"))), F.lit(0)).alias("terms")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64), (offsets - offsets[0]).astype(np.int64)


def all_terms(terms: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all three kinds, text by text, and the offsets of the texts."""
    words, w_at = _lists(terms.field("words"))
    stems, s_at = _lists(terms.field("stems"))
    n = len(w_at) - 1
    key, count = np.unique(np.repeat(np.arange(n), np.diff(s_at)) * BUCKETS + stems, return_counts=True)
    shared = key[count > 1]
    text = np.concatenate((np.repeat(np.arange(n), np.diff(w_at)), key // BUCKETS, shared // BUCKETS))
    value = np.concatenate((words, BUCKETS + key % BUCKETS, 2 * BUCKETS + shared % BUCKETS))
    order = np.argsort(text, kind="stable")
    return value[order], np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n))))


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % folds == 0


@dataclass
class Machine:
    """Bias, and a weight and factors for each bucket that the training rows had often enough."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def table(self) -> np.ndarray:
        """bucket -> row of weights and factors; the row after the last is zero and stands for all other buckets."""
        out = np.full(3 * BUCKETS, len(self.buckets), dtype=np.int32)
        out[self.buckets] = np.arange(len(self.buckets))
        return out

    def raw(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log-odds of texts whose rows are ``rows[offsets[k]:offsets[k + 1]]``."""
        weights = np.append(self.weights, np.float32(0))
        factors = np.vstack((self.factors, np.zeros(self.factors.shape[1], dtype=np.float32)))
        known = np.concatenate(([0], np.cumsum(rows < len(self.buckets))))[offsets]
        rows = rows[rows < len(self.buckets)]
        return self.bias + _sums(weights[rows], known) + 0.5 * (_sums(factors[rows], known) ** 2 - _sums(factors[rows] ** 2, known)).sum(axis=1)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each stretch between neighbouring offsets; empty stretches give zero."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=np.float64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(values, offsets[:-1][some], axis=0, dtype=np.float64)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", terms: int = 20_000_000) -> DataFrame:
    """Terms and label of at most ``bound`` labelled rows, with ``terms`` terms between them, of documents that are not held out.

    They are those of least hash of id and then of text, so that any run learns from the same ones
    and ids that repeat do not pass the bound. Ids with null or contradicting labels are left out.
    The chosen ids are bounded and so broadcast: documents are read, not shuffled.
    """
    once = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label")).dropna().filter(~held_out(F.col("_id")))
    once = once.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).filter("_label = _most").drop("_most")
    once = once.withColumn("_order", F.xxhash64("_id", F.lit("train"))).orderBy("_order", "_id").limit(bound)
    found = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(once), "_id")
    found = found.select("_id", F.col("_label").cast("int").alias("label"), hashed_terms("_text"), "_order", F.xxhash64("_text").alias("_tie"))
    chosen = found.orderBy("_order", "_id", "_tie").limit(bound)
    # of bounded rows, in one task
    so_far = F.sum(F.size("terms.words") + F.size("terms.stems")).over(Window.orderBy("_order", "_id", "_tie").rowsBetween(Window.unboundedPreceding, 0))
    return chosen.withColumn("_terms", so_far).filter(F.col("_terms") <= terms).select("_id", "label", "terms", "_tie")


def fit(
    rows: DataFrame, factors: int = 8, epochs: int = 20, batch: int = 256, rate: float = 0.15, decay: float = 1e-3, min_rows: int = 8, balance: float = 0.5, association: float = 10.0, folds: int = 5, seed: int = 7
) -> Machine:
    """AdaGrad on the logistic loss over bounded training rows.

    Buckets in fewer than ``min_rows`` rows are left out. Those whose chi-square with the label is
    under ``association`` get no weight. They may tell in pairs, but their factors also add noise: whether they
    have any is settled by the loss on one row in ``folds``, which is then trained on as well. Rows of label 1 count (rows of label 0 /
    rows of label 1) ** ``balance`` times. One label only, or no rows: the bias alone.
    """
    table = rows.orderBy("_id", "_tie").toArrow()
    labels = table["label"].to_numpy().astype(np.float64)
    chunks = table["terms"].combine_chunks()
    values, offsets = all_terms(chunks.chunk(0) if isinstance(chunks, pa.ChunkedArray) else chunks) if len(labels) else (np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64))
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    heavier = np.where(labels == 1, ((1 - share) / share) ** balance, 1.0)
    how = {"factors": factors, "epochs": epochs, "batch": batch, "rate": rate, "decay": decay, "min_rows": min_rows, "association": association, "seed": seed}

    def only(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.diff(offsets)
        return values[np.repeat(chosen, sizes)], np.concatenate(([0], np.cumsum(sizes[chosen]))), labels[chosen], heavier[chosen]

    all_rows = np.ones(len(labels), dtype=bool)
    late = np.arange(len(labels)) % folds == 0

    def loss(machine: Machine) -> float:
        v, at, y, w = only(late)
        raw = machine.raw(machine.table()[v], at)
        return float((w * (np.logaddexp(0, raw) - y * raw)).sum())

    losses = [loss(_train(*only(~late), few, **how)) for few in (True, False)] if late.any() and association > 0 else [1, 0]
    return _train(*only(all_rows), losses[0] <= losses[1], **how)


def _train(values: np.ndarray, offsets: np.ndarray, labels: np.ndarray, heavier: np.ndarray, few: bool, factors: int, epochs: int, batch: int, rate: float, decay: float, min_rows: int, association: float, seed: int) -> Machine:
    """A machine for texts of terms ``values[offsets[k]:offsets[k + 1]]``; with ``few`` only terms that tell alone have factors."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), np.zeros((0, factors), dtype=np.float32))
    if len(set(labels.tolist())) < 2:
        return machine
    buckets, places, counts = np.unique(values, return_inverse=True, return_counts=True)
    # chi-square of each bucket with the label: the weight of one that tells nothing alone would only add noise
    toxic = np.bincount(places, weights=np.repeat(labels, np.diff(offsets)), minlength=len(buckets))
    expected = counts * labels.mean()
    spread = expected * (1 - labels.mean()) * (1 - counts / len(labels))
    tells = (toxic - expected) ** 2 > association * np.maximum(spread, 1e-9)
    common = (counts >= min_rows) & (tells | (not few))
    alone = tells[common]
    position = np.where(common, np.cumsum(common) - 1, -1)[places]
    offsets = np.concatenate(([0], np.cumsum(position >= 0)))[offsets]
    position = position[position >= 0]
    rng = np.random.default_rng(seed)
    n = int(common.sum())
    w, v, b = np.zeros(n), rng.normal(0, 0.01, (n, factors)), machine.bias
    gw, gv, gb = np.full(n, 1e-3), np.full((n, factors), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            sizes = (offsets[own + 1] - offsets[own]).astype(np.int64)
            ends = np.cumsum(sizes)
            idx = position[np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(offsets[own], sizes)] if ends[-1] else position[:0]
            at = np.concatenate(([0], ends))
            total = _sums(v[idx], at)
            raw = b + _sums(w[idx], at) + 0.5 * (total**2 - _sums(v[idx] ** 2, at)).sum(axis=1)
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[own]
            error *= heavier[own]
            each = np.repeat(error, sizes)
            used, inverse = np.unique(idx, return_inverse=True)
            dw = np.bincount(inverse, weights=each, minlength=len(used)) / len(own) + decay * w[used]
            pull = each[:, None] * (np.repeat(total, sizes, axis=0) - v[idx])
            dv = np.stack([np.bincount(inverse, weights=pull[:, f], minlength=len(used)) for f in range(factors)], axis=1) / len(own) + decay * v[used]
            db = error.mean()
            gw[used] += dw**2
            gv[used] += dv**2
            gb += db**2
            w[used] -= rate * dw / np.sqrt(gw[used]) * alone[used]
            v[used] -= 0.25 * rate * dv / np.sqrt(gv[used])
            b -= rate * db / np.sqrt(gb)
    return Machine(float(b), buckets[common].astype(np.int64), w.astype(np.float32), v.astype(np.float32))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null, empty and wordless texts get the bias's score.

    The machine that goes to the tasks is bounded by the training rows; texts are hashed in the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = machine.table()
        for batch in batches:
            values, offsets = all_terms(batch[2])
            raw = machine.raw(table[values], offsets)
            p = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
            yield pa.record_batch([batch[0], batch[1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), hashed_terms(text_col))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = 12_000) -> DataFrame:
    """Fit on at most ``bound`` labelled documents that are not held out, and score all documents.

    Null and empty texts get the score of the bias, rows that repeat each have a row, and an empty table gives none.
    """
    return score(docs, fit(training_rows(docs, labels, bound)))
