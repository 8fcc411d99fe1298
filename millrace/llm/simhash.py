"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are cut into partitions of correlated bits, and each partition gets its own
threshold (-1: not searched). If the thresholds sum to ``distance - partitions + 1``, two
fingerprints within ``distance`` are within the threshold in some partition. A dynamic programme
picks the thresholds, over several numbers of partitions, for the least estimated candidates and
probes. Every fingerprint then probes the partitions' values around its own, and candidates are
verified on all bits.

A value that very many fingerprints share is not joined with itself. Its members emit the points
one bit around them instead: two fingerprints are within two bits exactly if they share such a
point, at most 65 fingerprints can share one, and a star over each point's members keeps the
connection. So no group makes all pairs. Components come from label propagation with pointer
jumping over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, one_of_each, result, scratch, text_key, text_or_empty, tidied

BITS = 64


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of a text's shingles in order, repeats included; words are lower-cased in A to Z. Fewer words than a shingle: the whole sequence."""
    from xxhash import xxh64_intdigest

    # bytes.lower() and bytes.split() know just the ASCII letters and the six ASCII blanks
    words = text.lower().split()
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), seed)] if words else [], dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """Bit set where over half of the hashes have it."""
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << j for j in np.flatnonzero(2 * counts > len(hashes)).tolist())


def _fingerprint(text: bytes, shingle: int, seed: int) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the text's key t0, t1, and fp (64 bits as a signed long) of whole texts. Null or wordless: 0; fewer words than a shingle: the whole sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_fingerprint(t, shingle, seed) for t in batch[3].cast(pa.binary()).to_pylist()]
            fp = np.array(found, dtype=np.uint64).astype(np.int64)
            yield pa.record_batch([*batch.columns[:3], pa.array(fp)], names=["doc_id", "t0", "t1", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_key(text_col), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, t0 long, t1 long, fp long")


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return _signed(sum(1 << b for b in self.bits))

    def flips(self) -> list[int]:
        """All changes of at most ``threshold`` of the part's bits."""
        return [_signed(sum(1 << b for b in c)) for t in range(self.threshold + 1) for c in combinations(self.bits, t)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def correlated_groups(sample: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Bits in ``parts`` groups of nearly equal size, each grown by the bit most correlated with it."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    bits -= bits.mean(axis=0) if len(bits) else 0
    norm = np.sqrt((bits**2).sum(axis=0)) + 1e-9
    link = np.abs(bits.T @ bits) / np.outer(norm, norm)
    np.fill_diagonal(link, 0)
    left, groups = set(range(BITS)), []
    for g in range(parts):
        size = BITS // parts + (g < BITS % parts)
        rest = sorted(left)
        own = [max(rest, key=lambda b: link[b, rest].sum())]
        left.remove(own[0])
        while len(own) < size:
            best = max(sorted(left), key=lambda b: link[b, own].sum())
            own.append(best)
            left.remove(best)
        groups.append(tuple(sorted(own)))
    return groups


def allocate(sample: np.ndarray, total: int, distance: int = 2, max_parts: int = 4) -> list[Part]:
    """Partitions and thresholds of least cost for ``total`` fingerprints, by dynamic programming.

    A partition costs the probes it takes and the candidates they meet, estimated from the sample's
    own pairs, and not under what independent, even bits would give.
    """
    sample = sample.astype(np.uint64)
    cross = sample[:, None] ^ sample[None, :]
    upper = np.triu_indices(len(sample), 1)
    best: tuple[float, list[Part]] | None = None
    for m in range(1, max_parts + 1):
        groups, costs = correlated_groups(sample, m), []
        for bits in groups:
            near = np.bitwise_count(cross & np.uint64(sum(1 << b for b in bits)))[upper]
            by_threshold = {-1: 0.0}
            for t in range(distance + 1):
                probes = sum(comb(len(bits), k) for k in range(t + 1))
                share = max(float((near <= t).mean()) if len(near) else 0.0, probes / 2.0 ** len(bits))
                by_threshold[t] = total * probes + share * total * total / 2
            costs.append(by_threshold)
        # state: sum of (threshold + 1) so far; the goal is distance + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for by_threshold in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in table.items():
                for t, c in by_threshold.items():
                    if used + t + 1 <= distance + 1 and (used + t + 1 not in step or cost + c < step[used + t + 1][0]):
                        step[used + t + 1] = (cost + c, [*chosen, t])
            table = step
        if distance + 1 in table and (best is None or table[distance + 1][0] < best[0]):
            best = (table[distance + 1][0], [Part(b, t) for b, t in zip(groups, table[distance + 1][1])])
    return [p for p in best[1] if p.threshold >= 0]


def _keys(parts: list[Part], probe: bool) -> Column:
    """The part values of ``fp``: its own, or all within the part's threshold."""
    out = [F.struct(F.lit(i).alias("part"), (F.col("fp").bitwiseAND(F.lit(p.mask)).bitwiseXOR(F.lit(flip))).alias("key")) for i, p in enumerate(parts) for flip in (p.flips() if probe else [0])]
    return F.explode(F.array(*out))


def links(distinct: DataFrame, distance: int = 2, sample_rows: int = 2000, dense: int = 256) -> DataFrame:
    """Edges a, b (a < b) that connect exactly the fingerprints within ``distance`` (1 or 2) of each other.

    ``distinct`` has a column ``fp`` without repeats. Every link is an edge or is implied by a path
    of edges within ``distance`` each. ``sample_rows`` bounds what the partitioning is fitted on;
    values that over ``dense`` fingerprints share go by the points around them.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    n = distinct.count()
    share = min(1.0, sample_rows / max(n, 1))
    rows = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(sample_rows).collect()
    sample = np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64)
    parts = allocate(sample, n, distance)
    index = distinct.select("fp", _keys(parts, False).alias("k")).select("fp", "k.part", "k.key")
    probes = distinct.select("fp", _keys(parts, True).alias("k")).select("fp", "k.part", "k.key")
    crowded = materialize(index.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > dense).select("part", "key"), "crowded")
    a = probes.join(crowded, ["part", "key"], "left_anti").select(F.col("fp").alias("a"), "part", "key")
    b = index.join(crowded, ["part", "key"], "left_anti").select(F.col("fp").alias("b"), "part", "key")
    sparse = a.join(b, ["part", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")

    around = F.explode(F.array(F.lit(0), *[F.lit(_signed(1 << j)) for j in range(BITS)]))
    members = probes.join(crowded, ["part", "key"], "left_semi").select("fp").distinct()
    points = members.select("fp", around.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), (F.col("flip") == 0).alias("own"))
    # at most 65 fingerprints lie around a point, so these lists are bounded
    groups = points.groupBy("point").agg(F.collect_list("fp").alias("fps"), F.max("own").alias("own")).filter(F.size("fps") > 1)
    hub = F.array_min("fps") if distance == 2 else F.col("point")
    star = (groups if distance == 2 else groups.filter("own")).select(hub.alias("h"), F.explode("fps").alias("x")).filter("h <> x")
    star = star.select(F.least("h", "x").alias("a"), F.greatest("h", "x").alias("b"))
    return sparse.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that each node of an edge table (a, b) can reach.

    Each round takes the least label among the neighbours, then the label's own label, until none
    changes. Tables are written every round, so lineage stays short and the joins can split a hub.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        hooked = materialize(labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", "m").alias("next")), "hooked")
        far = hooked.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        jumped = materialize(hooked.join(far, "next").select("node", F.col("label").alias("old"), F.least("next", "beyond").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("old <> label").isEmpty():
            return labels


def _grouped(docs: DataFrame, distance: int, shingle: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t0, t1, fp and ``best`` of every row: the first of its component's (no doc_id, doc_id, t0, t1)."""
    rows = materialize(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min(_rank()).alias("first")), "distinct-fingerprints")
    edges = materialize(links(distinct.select("fp"), distance), "links")
    labels = components(edges) if not edges.isEmpty() else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labelled = materialize(distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "labelled")
    names = labelled.groupBy("label").agg(F.min("first").alias("best"))
    named = materialize(labelled.join(names, "label").select("fp", "best"), "components")
    return rows.join(named, "fp")


def _rank() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t0", "t1")


@tidied
def near_duplicates(docs: DataFrame, distance: int = 2, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row.

    ``component_id`` is the smallest doc_id reachable over links. Wordless and null texts have
    fingerprint zero and are linked like any other; rows that repeat a doc_id each have a row; a
    null doc_id is never a component's name unless all its members have none. An empty table gives
    no rows.
    """
    found = _grouped(docs, distance, shingle, seed, id_col, text_col)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, distance: int = 2, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns: that of least doc_id, a null one last.

    Of rows that share that doc_id the one of least text key stays, and of rows that repeat both
    doc_id and text a single one, whichever it is.
    """
    with scratch(docs.sparkSession):
        found = _grouped(docs, distance, shingle, seed, id_col, text_col)
        gone = result(found.filter(_rank() != F.col("best")).select("doc_id", "t0", "t1").distinct(), "duplicates")
    return one_of_each(docs, gone, id_col, text_col)
