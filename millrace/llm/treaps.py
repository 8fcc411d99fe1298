"""Ranked lexical search over inverted treaps.

Every term's postings in a block of documents form a treap: a search tree by document that is a heap by
impact, so that a subtree's root is the largest impact in its range of documents. A query walks its terms' treaps at the same
time, over ranges of documents: the sum of the roots bounds the score of every document in the range. The ranges of highest bound are
split at the document of their heaviest root, which is scored, and a range goes as soon as its bound cannot enter
the best k. Blocks are searched where they are read; what leaves a task is the best k of each query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import best_of_each, materialize, tidied

#: ASCII letters and digits are kept, capitals made small, other ASCII characters part terms; bytes above belong to terms.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, ASCII digits and characters beyond ASCII in UTF-8 text, A-Z lower-cased."""
    return text.translate(_TABLE).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, length: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """What one occurrence of a term in a query adds to a document's score."""
    if 25 * int(length.max(initial=0)) * documents < 1 << 63:
        m = 75 + 25 * length * documents // tokens
    else:
        m = np.array([75 + 25 * n * documents // tokens for n in length.tolist()], dtype=np.int64)
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Treaps:
    """One treap a term over the documents 0, 1, ... of a block.

    Nodes are postings in order of (term, document). Equal impacts are told apart by a hash of the document, else runs of them would make chains.
    The last entry of every array stands for "no node".
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        if len(term) and term.max() < 1 << 16:
            term = term.astype(np.uint16)  # sorted by radix
        order = np.argsort(term, kind="stable")
        term, doc, impact = term[order], doc[order], impact[order]
        n = len(term)
        mixed = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        heap = (impact << 20) + mixed.astype(np.int64)
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if n else np.zeros(0, dtype=np.int64)
        first = np.repeat(starts, np.diff(np.r_[starts, n]))
        last = np.repeat(np.r_[starts[1:], n] - 1, np.diff(np.r_[starts, n])) if n else first
        at = np.arange(n)
        # the nearest larger nodes on both sides, by jumping over what is known to be smaller
        before, after = at - 1, at + 1
        live = at[before >= first]
        while len(live):
            live = live[heap[before[live]] <= heap[live]]
            before[live] = before[before[live]]
            live = live[before[live] >= first[live]]
        live = at[after <= last]
        while len(live):
            live = live[heap[after[live]] < heap[live]]
            after[live] = after[after[live]]
            live = live[after[live] <= last[live]]
        has_before, has_after = before >= first, after <= last
        # the parent is the smaller of the two
        heap = np.r_[heap, -1]
        right_child = has_before & (~has_after | (heap[np.where(has_before, before, n)] <= heap[np.where(has_after, after, n)]))
        left_child = has_after & ~right_child
        self.left, self.right = np.full(n + 1, -1, dtype=np.int32), np.full(n + 1, -1, dtype=np.int32)
        self.left[after[left_child]] = at[left_child]
        self.right[before[right_child]] = at[right_child]
        self.doc, self.impact = np.r_[doc, -1].astype(np.int32), np.r_[impact, 0]
        roots = at[~has_before & ~has_after]
        self.roots = dict(zip(term[roots].tolist(), roots.tolist()))

    def _inside(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each range (row) and term, the topmost node at or below ``node`` with low <= document < high."""
        node, width = node.copy(), node.shape[1]
        flat = node.reshape(-1)
        live = np.flatnonzero(flat >= 0)
        while len(live):
            own, row = flat[live], live // width
            doc = self.doc[own]
            late, early = doc >= high[row], doc < low[row]
            moved = late | early
            live, own, late = live[moved], own[moved], late[moved]
            flat[live] = own = np.where(late, self.left[own], self.right[own])
            live = live[own >= 0]
        return node

    def _at(self, node: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The node of each range's document below ``node``, or no node."""
        node, width = node.copy(), node.shape[1]
        flat = node.reshape(-1)
        live = np.flatnonzero(flat >= 0)
        while len(live):
            own, want = flat[live], doc[live // width]
            have = self.doc[own]
            moved = have != want
            live, own, late = live[moved], own[moved], have[moved] > want[moved]
            flat[live] = own = np.where(late, self.left[own], self.right[own])
            live = live[own >= 0]
        return node

    def best(self, query: dict[int, int], k: int, floor: int = 0, step: int = 4096) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and documents of the best k of a query (term -> times), best first, and the number of documents scored.

        Of equal scores the lower document wins; scores of 0 or under ``floor`` are not looked for. ``step`` ranges at most are
        split at once, those of highest bound first.
        """
        terms = [t for t in query if t in self.roots]
        scores, docs = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        times = np.array([query[t] for t in terms], dtype=np.int64)
        node = np.array([[self.roots[t] for t in terms]], dtype=np.int32).reshape(1, -1)
        low, high = np.zeros(1, dtype=np.int64), np.full(1, 1 << 31, dtype=np.int64)
        bound, scored, size = self.impact[node] @ times, 0, 16
        while True:
            least = max(floor, 1)
            live = bound >= least
            if len(scores) == k:
                live &= (bound > scores[-1]) | (bound == scores[-1]) & (low < docs[-1])
            if not live.all():
                node, low, high, bound = node[live], low[live], high[live], bound[live]
            if not len(bound):
                return scores, docs, scored
            if len(bound) > size:
                chosen = np.argpartition(-bound, size)[:size]
            else:
                chosen = np.arange(len(bound))
            own, lo, hi = node[chosen], low[chosen], high[chosen]
            heaviest = np.argmax(self.impact[own] * times, axis=1)
            pivot = self.doc[own[np.arange(len(own)), heaviest]].astype(np.int64)
            found = self.impact[self._at(own, pivot)] @ times
            scored += len(pivot)
            good = found >= least
            scores, docs = np.r_[scores, found[good]], np.r_[docs, pivot[good]]
            order = np.lexsort((docs, -scores))[:k]
            scores, docs = scores[order], docs[order]
            rest = np.ones(len(bound), dtype=bool)
            rest[chosen] = False
            low, high = np.r_[low[rest], lo, pivot + 1], np.r_[high[rest], pivot, hi]
            new = self._inside(np.concatenate([own, own]), low[-2 * len(own) :], high[-2 * len(own) :])
            node, bound = np.concatenate([node[rest], new]), np.r_[bound[rest], self.impact[new] @ times]
            size = min(step, 2 * size)


def postings(docs: DataFrame, vocabulary: dict[bytes, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id, n, terms, tfs``: its terms with repeats, and the numbers and counts of those in the vocabulary.

    Whole texts are read; null has none. Narrow.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = known.value
        for batch in batches:
            n, ends, terms, tfs = [], [0], [], []
            for text in batch[1].to_pylist():
                own = terms_of(text or b"")
                counted = Counter(own)
                n.append(len(own))
                for t in counted.keys() & ids.keys():
                    terms.append(ids[t])
                    tfs.append(counted[t])
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.record_batch([batch[0], pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def _search(batches: Iterator[pa.RecordBatch], queries: list[tuple[int, int | None, dict[int, int]]], weights: np.ndarray, documents: int, tokens: int, k: int, block_rows: int, block_postings: int) -> Iterator[pa.RecordBatch]:
    """The best k of each query in a task's documents, block by block; what is found in one block is the floor of the next."""
    best: dict[int, list[tuple[int, bool, int]]] = {q[0]: [] for q in queries}
    held: list[pa.RecordBatch] = []

    def search_block() -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        columns = {c: table[c].chunk(0) for c in table.column_names}
        ids = columns["doc_id"]
        null = ids.is_null().to_numpy(zero_copy_only=False)
        numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((numbers, null))  # a block's documents in order of doc_id, null last
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        sizes = np.diff(columns["terms"].offsets.to_numpy())
        doc, length = np.repeat(place, sizes), np.repeat(columns["n"].to_numpy(), sizes)
        term, tf = (columns[c].flatten().to_numpy() for c in ("terms", "tfs"))
        by_doc = np.argsort(doc, kind="stable")
        term, doc, tf, length = term[by_doc], doc[by_doc], tf[by_doc].astype(np.int64), length[by_doc]
        treaps = Treaps(term, doc, impacts(weights[term], tf, length, documents, tokens))
        for number, _, query in queries:
            own = best[number]
            scores, docs, _ = treaps.best(query, k, -own[-1][0] if len(own) == k else 0)
            rows = order[docs]
            own += zip((-scores).tolist(), null[rows].tolist(), numbers[rows].tolist())
            own.sort()
            del own[k:]

    rows = count = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            held.append(part)
            rows, count = rows + part.num_rows, count + len(part["terms"].flatten())
            if rows >= block_rows or count >= block_postings:
                search_block()
                rows = count = 0
    if held:
        search_block()
    for number, item_id, _ in queries:
        own = best[number]
        yield pa.record_batch(
            [pa.array([number] * len(own), pa.int64()), pa.array([item_id] * len(own), pa.int64()), pa.array([None if null else d for _, null, d in own], pa.int64()), pa.array([-s for s, _, _ in own], pa.int64())],
            names=["item", "item_id", "doc_id", "score"],
        )


@tidied
def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", terms_per_pass: int = 1_000_000, block_rows: int = 32_768, block_postings: int = 2_000_000) -> DataFrame:
    """Per item its ``k`` best documents of score above 0: item_id, rank, doc_id, score.

    Every row of ``docs`` is a document and every row of ``items`` a query, also those that repeat; null texts have no terms, items without a known term no
    rows, and of equal scores the lower doc_id comes first, null last. Empty tables give no rows. The driver and the tasks hold the items of one pass, with
    about ``terms_per_pass`` distinct terms between them; more items are more passes over the documents. A block's treaps are bounded
    by ``block_rows`` and ``block_postings`` (and one batch of 512 documents).
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms_of(t or b"")) for t in batch[1].to_pylist()]
            yield pa.record_batch([batch[0], pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["item_id", "terms", "times"])

    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.encode(F.col(item_text), "UTF-8").alias("text"))
    asked = materialize(asked.mapInArrow(split, "item_id long, terms array<binary>, times array<long>").withColumn("item", F.monotonically_increasing_id()), "items")
    total = asked.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    passes = max(1, -(-total // terms_per_pass))
    found = None
    for p in range(passes):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).collect()
        vocabulary: dict[bytes, int] = {}
        queries = [(r.item, r.item_id, {vocabulary.setdefault(bytes(t), len(vocabulary)): n for t, n in zip(r.terms, r.times)}) for r in rows]
        forward = materialize(postings(docs, vocabulary, id_col, text_col), "postings")
        size = forward.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("tokens")).first()
        weights = np.zeros(max(1, len(vocabulary)), dtype=np.int64)
        for r in forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # a row a term of the pass
            weights[r.term] = weight(size.documents, r.df)
        sent = docs.sparkSession.sparkContext.broadcast((queries, weights, size.documents, size.tokens or 1))
        search = lambda batches, sent=sent: _search(batches, *sent.value, k, block_rows, block_postings)
        own = forward.mapInArrow(search, "item long, item_id long, doc_id long, score long")
        found = own if found is None else found.unionByName(own)
    return best_of_each(found, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
s AS (SELECT count(*) AS documents, sum(len(ts))::BIGINT AS tokens FROM d WHERE len(ts) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
q AS (SELECT i, t, count(*) AS times FROM (SELECT i, unnest(ts) AS t FROM b) GROUP BY i, t),
w AS (SELECT t, floor(1000 * ln((2 * (SELECT documents FROM s) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY t),
f AS (SELECT tf.r, d.doc_id, tf.t, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * len(d.ts) * (SELECT documents FROM s)) // (SELECT tokens FROM s)))) AS impact FROM tf JOIN w USING (t) JOIN d USING (r)),
x AS (SELECT q.i, f.r, f.doc_id, sum(q.times * f.impact)::BIGINT AS score FROM q JOIN f USING (t) GROUP BY q.i, f.r, f.doc_id),
y AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
SELECT b.item_id, y.rank::INTEGER AS rank, y.doc_id, y.score FROM y JOIN b USING (i) WHERE y.rank <= 20
"""
