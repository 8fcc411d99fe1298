import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from millrace.llm import packing, spfp
from millrace.llm.common import materialize
from millrace.llm.tokens import default_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def one_by_one(lengths, capacity):
    """Longest first, each into the shortest pack in which it fits; the contents of the packs."""
    packs = []
    for n in sorted(lengths, reverse=True):
        fits = [p for p in packs if sum(p) + n <= capacity]
        if fits:
            min(fits, key=sum).append(n)
        else:
            packs.append([n])
    return packs


@pytest.mark.parametrize("seed", range(60))
def test_plan_equals_packing_one_by_one(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 2, 7, 20, 64])
    lengths = [min(capacity, max(1, int(r.expovariate(r.choice([0.05, 0.3, 1]))))) for _ in range(r.choice([0, 1, 5, 60, 300]))] + [r.randint(1, capacity)] * r.choice([0, 40])
    histogram = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, int)
    plan = spfp.shortest_pack_first(histogram, capacity)
    want = one_by_one(lengths, capacity)
    # which of two equally filled packs takes a piece is open, and with it the patterns: fills are not
    assert plan.packs == len(want) == sum(n for n, _ in plan.patterns)
    assert sorted(c * n for k, p in plan.patterns for c, n in [(sum(a * b for a, b in p), 1)] for _ in range(k)) == sorted(map(sum, want))
    assert Counter({n: c for n, c in enumerate(histogram.tolist()) if c}) == sum((Counter({a: b * k for a, b in p}) for k, p in plan.patterns), Counter())
    # the placements cover each rank of a length once, and each pack without a gap
    ranks, packs = defaultdict(list), defaultdict(list)
    for n, rank, pack, count, offset in zip(plan.length, plan.rank, plan.pack, plan.count, plan.offset):
        ranks[n] += range(rank, rank + count)
        for p in range(pack, pack + count):
            packs[p].append((offset, n))
    assert all(sorted(x) == list(range(histogram[n])) for n, x in ranks.items())
    for places in packs.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity


def test_plan_of_very_many_pieces_is_small():
    r = random.Random(1)
    histogram = np.array([0, *(r.randint(0, 10**12) for _ in range(2048))])
    plan = spfp.shortest_pack_first(histogram, 2048)
    assert len(plan.length) < 60_000 and plan.packs * 2048 < 1.1 * int((histogram * np.arange(2049)).sum())
    with pytest.raises(ValueError):
        spfp.shortest_pack_first(np.array([0, 1, 1]), 1)


@pytest.mark.parametrize("capacity", [8, 100, 2048])
def test_pack_by_histogram(docs, rows, no_docs, capacity):
    library = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    placed = [r.asDict() for r in spfp.pack_by_histogram(docs, capacity).collect()]
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for at in range(0, len(ids), capacity):
            want[(doc_id, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in placed) == want
    by_sequence = defaultdict(list)
    for r in placed:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = [r["length"] for r in placed]
    assert packing.lower_bound(np.array(lengths), capacity) <= len(by_sequence) == len(one_by_one(lengths, capacity))
    assert spfp.pack_by_histogram(no_docs, capacity).count() == 0
    assert spfp.pack_by_histogram(no_docs, capacity).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_sequences_hold_the_ids(spark, docs, rows):
    pieces = materialize(spfp.ranked_pieces(docs, 64, keep_ids=True), "pieces-with-ids")
    placed = materialize(spfp.place(pieces, 64), "placed-with-ids")
    whole = {r.sequence_id: r.ids for r in spfp.packed_ids(placed).collect()}
    for r in placed.collect():
        assert np.array(whole[r.sequence_id][r.offset : r.offset + r.length], dtype="<u4").tobytes() == bytes(r.ids)
    # a length that all rows share, in more tasks than one, and no end id
    many = spark.range(2000).repartition(5).select(F.col("id").alias("doc_id"), F.lit("one and the same text").alias("text"))
    same = spfp.pack_by_histogram(many, 64)
    assert same.select("sequence_id", "offset").distinct().count() == 2000
    assert spfp.place(materialize(spfp.ranked_pieces(docs.filter("text = ''"), 64, end_id=None), "nothing"), 64).count() == 0
