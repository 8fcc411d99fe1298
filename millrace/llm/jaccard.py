"""Near-duplicates by SimHash, with an exact check: Jaccard similarity of five-word shingles.

Fingerprints are searched first, by the partitions and thresholds of ``simhash``; what they link is verified on the whole
sets, and its components are settled. Fingerprints of texts of similarity 0.8 differ in about ten of 64 bits, more than can be searched in work
that grows as the texts do, so the pairs between components that are left go by an exact way, a
prefix filter, which loses no pair: with all shingles in one order, two sets of
similarity 0.8 share one of their first n - ceil(0.8 n) + 1, and the first that they share has so few
before it on both sides that the rest can still make the overlap. The order is rarest first, by
counts in a bounded sample of documents. Only a third of all shingles, told by their hashes, are counted and come
first, as prefixes seldom need others. The sample only decides how many candidates there are. Parities of the
shingles in four bits or more a shingle, whose differences are never more than the sets', drop most candidates, and
those left are verified on the whole sets.

A shingle that very many sets have in front is not joined with itself. Its sets are compared with a
few hubs first, the one with the least before it among them. Then only sets outside the component of its
first hub are compared with all the others, which again loses no pair between components. They are
compared by their sketches, in blocks of bounded size, and a pair is given out only where these leave a doubt.

What is kept of a text is its prefix and its sketch. Whole sets are never stored: only texts in a candidate
pair that the sketches leave in doubt are read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, one_of_each, result, scratch, shuffle_partitions, text_key, text_or_empty
from .simhash import components, links, majority, shingle_hashes

#: Words of a shingle, the hashes' seed, and one in how many shingles is counted.
SHINGLE, SEED, COUNTED = 5, 42, 3
#: Sets a and b are near if |a & b| / |a | b| >= 4/5: if NEAR[0] * |a & b| >= NEAR[1] * (|a| + |b|).
NEAR = (9, 4)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted XXH64 of a text's different shingles."""
    return np.unique(shingle_hashes(text, SHINGLE, SEED))


def common_shingles(docs: DataFrame, text_col: str, sample_rows: int, least: int = 4, most: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """Of the shingles that are counted, those that ``least`` of the sampled rows have, sorted, and how many have them; the ``most`` frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text) for text in batch[0].cast(pa.binary()).to_pylist()]
            if sets:
                all_ = np.concatenate(sets)
                yield pa.record_batch([pa.array(all_[all_ % np.uint64(COUNTED) == 0].view(np.int64))], names=["h"])

    share = min(1.0, sample_rows / max(docs.count(), 1))
    text = text_or_empty(text_col)
    sampled = docs.select(text.alias("text")).filter(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    counts = sampled.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = (found[k].to_numpy() for k in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], n[order]


def sketch(own: np.ndarray) -> bytes:
    """Parities of a set's shingles in a power of two of bits, four times as many as shingles at least; halves fold by exclusive or."""
    bits = max(64, 4 << max(len(own) - 1, 0).bit_length())
    parity = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def differences(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, never more than the shingles that just one of the sets has."""
    a, b = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
    if len(a) != len(b):
        short, long_ = sorted((a, b), key=len)
        a, b = short, np.bitwise_xor.reduce(long_.reshape(-1, len(short)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the text's key t0, t1, its set's digest and size n, its prefix, its sketch and the text's fingerprint fp, of each row."""
    import hashlib

    known, counts = common
    names = ["doc_id", "t0", "t1", "digest", "n", "prefix", "sketch", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch[3].cast(pa.binary()).to_pylist():
                all_ = shingle_hashes(text, SHINGLE, SEED)
                own = np.unique(all_)
                n = len(own)
                at = np.searchsorted(known, own)
                at[at == len(known)] = 0
                often = np.where(known[at] == own, counts[at] + 1, 0) if len(known) else np.zeros(n, dtype=np.int64)
                # those not counted come after the counted ones that are rare
                often[own % np.uint64(COUNTED) != 0] = 1
                front = np.argsort(often, kind="stable")[: n - -(-4 * n // 5) + 1]
                rows.append((hashlib.blake2b(own.tobytes(), digest_size=16).digest(), n, own[front].view(np.int64) if n else [], sketch(own), int(np.uint64(majority(all_)).astype(np.int64))))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, (pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64()))]
            yield pa.record_batch([*batch.columns[:3], *columns], names=names)

    schema = "doc_id long, t0 long, t1 long, digest binary, n int, prefix array<long>, sketch binary, fp long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_key(text_col), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def _possible(shared, a_n, b_n):
    """Whether sets of these sizes that share so many at most can be near."""
    return NEAR[0] * shared >= NEAR[1] * (a_n + b_n)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, place, node, n) in order, few of a key: the pairs (a, b) of a key's sets that can be near by size and place."""
    held = np.zeros((0, 4), dtype=np.int64)  # the last key's members so far

    def pairs(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        out = [np.zeros((0, 2), dtype=np.int64)]
        for s, e in zip(starts.tolist(), ends.tolist()):
            i, j = np.triu_indices(e - s, 1)
            left, right = rows[s:e][i], rows[s:e][j]
            shared = np.minimum(left[:, 3] - left[:, 1], right[:, 3] - right[:, 1])
            ok = _possible(shared, left[:, 3], right[:, 3]) & (left[:, 2] != right[:, 2])
            out.append(np.sort(np.stack((left[ok, 2], right[ok, 2]), axis=1), axis=1))
        both = np.concatenate(out)
        return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            rows = np.concatenate((held, np.stack([batch[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)))
            starts = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
            ends = starts[1:]
            several = ends - starts[:-1] > 1
            held = rows[starts[-1] :]
            yield pairs(rows, starts[:-1][several], ends[several])
    if len(held) > 1:
        yield pairs(held, np.zeros(1, dtype=np.int64), np.array([len(held)]))


def doubtful(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes of different labels that can be near by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the shared ones are half of what the sizes leave besides the differences
            keep = [_possible(n + m - differences(x, y), 2 * n, 2 * m) for n, m, x, y in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    sketches = nodes.select("node", "n", "sketch", "label")
    both = pairs.alias("p").join(sketches.alias("a"), F.col("p.a") == F.col("a.node")).join(sketches.alias("b"), F.col("p.b") == F.col("b.node")).filter("a.label <> b.label")
    return both.select("p.a", "p.b", F.col("a.n").alias("n"), F.col("b.n").alias("m"), F.col("a.sketch").alias("x"), F.col("b.sketch").alias("y")).mapInArrow(run, "a long, b long")


def doubtful_in_blocks(few: DataFrame, many: DataFrame, nodes: DataFrame, block: int = 2048) -> DataFrame:
    """Pairs (a, b) of members of a key, one of ``few`` and one of ``many``, of different labels, that can be near by place and by sketch.

    Both have key, node, n, place, label. Sizes of near sets differ by a quarter at most, so members meet those of their own
    class of sizes and of the two beside it. A class is dealt into blocks of about ``block``, and each pair of blocks is a group of
    its own, wherever it is dealt: a member goes to as many groups as the other side has blocks. No row is made for a pair that is ruled out.
    """
    size_class = F.floor(F.log(F.greatest("n", F.lit(1)) * 1.0) / float(np.log(1.25))).cast("int")
    member = F.struct("node", "n", "place", "label", "sketch").alias("member")
    withs = lambda m: m.join(nodes.select("node", "sketch"), "node").select("key", "node", size_class.alias("class"), member)
    left = withs(few).withColumn("class", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])))
    right = withs(many)
    counts = [m.groupBy("key", "class").agg(F.ceil(F.count("*") / block).cast("int").alias(name)) for m, name in ((left, "xs"), (right, "ys"))]
    both = materialize(counts[0].join(counts[1], ["key", "class"]), "block-counts")

    def blocks(members: DataFrame, own: str, other: str, name: str) -> DataFrame:
        dealt = members.join(both, ["key", "class"]).withColumn(own[0], F.pmod(F.xxhash64("node"), F.col(own)).cast("int"))
        dealt = dealt.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return dealt.groupBy("key", "class", "x", "y").agg(F.collect_list("member").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch[0], batch[1]):
                found = _near_by_sketch(*map(_members, (x, y)))
                yield pa.record_batch([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], names=["a", "b"])

    met = blocks(left, "xs", "ys", "few").join(blocks(right, "ys", "xs", "many"), ["key", "class", "x", "y"]).select("few", "many")
    return met.mapInArrow(run, "a long, b long").distinct()


def _members(block: pa.ListScalar) -> tuple[np.ndarray, list[bytes]]:
    """Columns node, n, place, label of a block, and its sketches."""
    values = block.values
    return np.stack([values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1), values.field(4).to_pylist()


def _near_by_sketch(few: tuple[np.ndarray, list[bytes]], many: tuple[np.ndarray, list[bytes]], at_once: int = 1 << 22) -> np.ndarray:
    """Rows (node, node) of the pairs that places and sketches leave possible."""

    def by_length(own: tuple[np.ndarray, list[bytes]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        lengths = np.array([len(x) for x in own[1]])
        return {int(n): (own[0][lengths == n], np.frombuffer(b"".join(x for x in own[1] if len(x) == n), dtype="<u8").reshape(-1, n // 8)) for n in np.unique(lengths)}

    out = [np.zeros((0, 2), dtype=np.int64)]
    right = by_length(many)
    for p, (a, x) in by_length(few).items():
        for q in (p // 2, p, 2 * p):  # sizes of near sets differ by a quarter at most
            if q not in right:
                continue
            b, y = right[q]
            shorter = min(p, q) // 8
            u, v = (np.bitwise_xor.reduce(z.reshape(len(z), -1, shorter), axis=1) for z in (x, y))
            shared = np.minimum((a[:, 1] - a[:, 2])[:, None], (b[:, 1] - b[:, 2])[None, :])
            i, j = np.nonzero(_possible(shared, a[:, 1][:, None], b[:, 1][None, :]) & (a[:, 3][:, None] != b[:, 3][None, :]))
            step = max(1, at_once // (8 * shorter))
            for k in range(0, len(i), step):
                s, t = i[k : k + step], j[k : k + step]
                sizes = a[s, 1] + b[t, 1]
                near = _possible(sizes - np.bitwise_count(u[s] ^ v[t]).sum(axis=1, dtype=np.int64), 2 * a[s, 1], 2 * b[t, 1])
                out.append(np.stack((a[s[near], 0], b[t[near], 0]), axis=1))
    return np.concatenate(out)


def verified(doubt: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The near ones of the pairs (a, b) of nodes, by their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, own = None, None  # neighbouring pairs often share their first text
        for batch in batches:
            near = []
            for a, x, y in zip(batch[0].to_pylist(), batch[2].cast(pa.binary()).to_pylist(), batch[3].cast(pa.binary()).to_pylist()):
                if a != node:
                    node, own = a, shingle_set(x)
                other = shingle_set(y)
                near.append(_possible(len(np.intersect1d(own, other, assume_unique=True)), len(own), len(other)))
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    doubt = materialize(doubt, "near-candidates")
    wanted = doubt.select(F.col("a").alias("node")).unionByName(doubt.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "t0", "t1"), "node")
    read = docs.select(*text_key(text_col), text_or_empty(text_col).alias("text"))
    # copies of a text are one row a task before they are dealt
    texts = materialize(read.join(wanted, ["t0", "t1"]).groupBy("node").agg(F.first("text").alias("text")), "near-texts")
    rows = doubt.alias("p").join(texts.alias("b"), F.col("p.b") == F.col("b.node")).select("p.a", "p.b", F.col("b.text").alias("y"))
    rows = rows.alias("p").join(texts.alias("a"), F.col("p.a") == F.col("a.node")).select("p.a", "p.b", F.col("a.text").alias("x"), "p.y")
    return materialize(rows.mapInArrow(run, "a long, b long"), "near-pairs")


def _labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``label``, the least node that they reach over edges."""
    if edges.isEmpty():
        return nodes.withColumn("label", F.col("node"))
    return nodes.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))


def fingerprint_links(nodes: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Edges a, b (a < b) of near sets whose texts' fingerprints are equal or linked.

    A fingerprint is told by its least node. Its others are compared with that one, and that one with those of the linked fingerprints,
    so that one which very many texts share makes no pairs of all.
    """
    told = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least")), "told-fingerprints")
    apart = materialize(links(told.select("fp")), "linked-fingerprints")
    between = apart.join(told.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(told.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    pairs = between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = pairs.unionByName(nodes.select("fp", "node").join(told, "fp").filter("least < node").select(F.col("least").alias("a"), F.col("node").alias("b")))
    return verified(doubtful(pairs, nodes.withColumn("label", F.col("node"))), nodes, docs, text_col)


def near_links(nodes: DataFrame, docs: DataFrame, known: DataFrame, text_col: str = "text", dense: int = 64, block: int = 2048) -> DataFrame:
    """Edges a, b (a < b) of near sets that connect exactly what all near pairs connect, those ``known`` among them.

    ``nodes`` are different sets with the columns of ``prefixes``. Pairs that known edges connect are not compared again. Keys that over ``dense`` of them
    have in their prefixes go by three of their sets first.
    """
    index = materialize(nodes.select(F.posexplode("prefix").alias("place", "key"), "node", "n").select("key", "place", "node", "n"), "prefix-index")
    member = F.struct("place", "node", "n")
    # sums and least ones are made before the shuffle, so that a shingle that very many sets have gathers nowhere
    hub = [F.min(member).alias("first"), F.max(member).alias("last"), F.min_by(member, F.xxhash64("node")).alias("any")]
    crowded = materialize(index.groupBy("key").agg(F.count("*").alias("sets"), *hub).filter(F.col("sets") > dense).drop("sets"), "crowded-shingles")
    plain = index.join(crowded.select("key"), "key", "left_anti")
    dealt = plain.repartition(shuffle_partitions(nodes.sparkSession), "key").sortWithinPartitions("key", "place", "node")
    many = materialize(index.join(crowded, "key"), "crowded-members")
    near_hub = many.select("node", "n", "place", F.explode(F.array("first", "last", "any")).alias("hub"))
    shared = F.least(F.col("n") - F.col("place"), F.col("hub.n") - F.col("hub.place"))
    near_hub = near_hub.filter((F.col("node") != F.col("hub.node")) & _possible(shared, F.col("n"), F.col("hub.n")))
    pairs = dealt.mapInArrow(_groups, "a long, b long").unionByName(near_hub.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))).distinct()
    edges = known.unionByName(verified(doubtful(pairs, _labelled(nodes, known)), nodes, docs, text_col))
    many = many.select("key", "node", "place", "n")
    if many.isEmpty():
        return edges
    many = materialize(_labelled(many, edges), "crowded-prefixes")
    main = many.groupBy("key").agg(F.min_by("label", F.struct("place", "node")).alias("main"))
    strays = materialize(many.join(main, "key").filter("label <> main").drop("main"), "strays")
    if strays.isEmpty():
        return edges
    rest = doubtful_in_blocks(strays, many, nodes, block)
    return edges.unionByName(verified(rest, nodes, docs, text_col)).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 40_000, dense: int = 64, block: int = 2048) -> DataFrame:
    """doc_id, t0, t1, component_id and kept of every row: the smallest doc_id reachable over near pairs, and whether (doc_id, text) is its component's choice.

    The choice is the text of least doc_id, a null one last, and of least key among those. Texts of equal
    sets are near, so all wordless and null ones are. A null doc_id is never a component's name
    unless all its members have none.
    """
    found = prefixes(docs, common_shingles(docs, text_col, sample_rows), id_col, text_col)
    rows = materialize(found.withColumn("row", F.monotonically_increasing_id()), "shingle-prefixes")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t0", "t1")
    distinct = materialize(rows.groupBy("digest").agg(F.min("row").alias("node"), F.min(rank).alias("first")), "distinct-sets")
    nodes = rows.join(distinct.select(F.col("node").alias("row")), "row").drop("digest", "doc_id").withColumnRenamed("row", "node")
    edges = materialize(near_links(nodes, docs, fingerprint_links(nodes, docs, text_col), text_col, dense, block), "links")
    labelled = materialize(_labelled(distinct, edges).select("digest", "first", "label"), "labelled")
    names = labelled.groupBy("label").agg(F.min("first").alias("best"))
    named = materialize(labelled.join(names, "label").select("digest", "best"), "components")
    both = rows.select("doc_id", "t0", "t1", "digest").join(named, "digest")
    return both.select("doc_id", "t0", "t1", F.col("best.doc_id").alias("component_id"), (rank == F.col("best")).alias("kept"))


def keep_one_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies, with all its columns: that of least doc_id, a null one last.

    Of rows that repeat both doc_id and text a single one stays, whichever it is.
    """
    with scratch(docs.sparkSession):
        found = near_copies(docs, id_col, text_col)
        gone = result(found.filter("NOT kept").select("doc_id", "t0", "t1").distinct(), "near-duplicates")
    return one_of_each(docs, gone, id_col, text_col)
