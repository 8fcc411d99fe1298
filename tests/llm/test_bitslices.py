import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from millrace.llm import bitslices, queries
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed: int, n: int, d: int = 6, spread: float = 0.4):
    """Clusters by label, with repeated rows and vectors, ties, nulls, short and empty vectors."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(10)]
    rows = []
    for i in range(n):
        label = r.randrange(10)
        rows.append((i, [float(np.float32(c + r.gauss(0, spread))) for c in centres[label]], label))
    rows += [(100, rows[0][1], 3), (100, rows[0][1], 3), (n + 1, rows[3][1], 4), (n + 1, rows[3][1], 4), rows[8], rows[8], (-100, rows[5][1], 5), (-7, rows[5][1], 9)]
    rows += [(None, rows[7][1], 2), (200, None, 1), (300, rows[2][1], None), (400, [1.0, None], 1), (500, [float("nan")] * d, 1), (600, [float("inf")] * d, 2), (700, [], 3), (800, [0.5], 3), (900, [0.0] * d, 3), (n + 2, [1e30] * d, 3)]
    return rows


def brute(rows, every=100, positives=5, negatives=10):
    held = []
    for vec_id, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) < 1e9 for x in v):
            held.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = Counter()
    for a, (anchor, label, q) in enumerate(held):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(x * y for x, y in zip(q, w)), v, m == label) for b, (v, m, w) in enumerate(held) if b != a]
        for ps, positive, _ in sorted((x for x in scored if x[2]), key=key)[:positives]:
            fits = [x for x in scored if not x[2] and 30 * ps <= 100 * x[0] <= 90 * ps]
            for rank, (score, negative, _) in enumerate(sorted(fits, key=key)[:negatives], 1):
                out[anchor, positive, rank, negative, ps, score] += 1
    return out


@pytest.mark.parametrize("seed,bounds", [(1, {}), (2, {"anchors_per_pass": 2, "tile": 50, "block": 3}), (3, {"every": 5, "block": 16})])
def test_hard_negatives(spark, seed, bounds):
    rows = vectors(seed, 700)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit("clash").alias(c) for c in ("q", "v", "row", "score", "rank", "t", "anchor", "_part")])
    got = bitslices.hard_negatives(df, **bounds)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, bounds.get("every", 100))
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100
    assert bitslices.hard_negatives(df.limit(0)).count() == 0
    assert bitslices.hard_negatives(df.filter("vec_id % 100 != 0")).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_tiles_equal_all_products(seed):
    """Scores of few values, so that ties are many, and of values that need 64 bits; one tile after another."""
    r = np.random.default_rng(seed)
    size, d, m, n, ranges, k = int(r.choice([1, 2, 300, 1 << 23])), int(r.integers(1, 9)), int(r.integers(1, 20)), 300, int(r.integers(1, 4)), int(r.integers(1, 6))
    a, q = r.integers(-size, size + 1, (m, d)), r.integers(-size, size + 1, (n, d))
    label_a, label, ids = r.integers(0, 3, m), r.integers(0, 3, n), r.integers(0, 200, n)
    scores = a @ q.T
    low = np.sort(r.choice(scores.reshape(-1), (m, ranges)) if seed % 3 else np.full((m, ranges), -(1 << 62)))
    high = low + r.integers(-1, max(2, scores.std() * 2), (m, ranges)) if seed % 3 else np.full((m, ranges), 1 << 62)
    bits = 1 + int(max(np.abs(q).max(), 1)).bit_length()
    anchors = bitslices.Anchors(np.arange(m), label_a, a, low, high, k, bool(seed % 2))
    for at in range(0, n, 100):
        c = slice(at, at + 100)
        bitslices.search_tile(anchors, np.arange(n)[c], ids[c], np.zeros(n, dtype=np.int64)[c], label[c], q[c], bits, share=[1 / 16, 1.0, 0.0][seed % 3])
    want = []
    for i in range(m):
        for t in range(ranges):
            fits = [(-int(scores[i, j]), int(ids[j])) for j in range(n) if low[i, t] <= scores[i, j] <= high[i, t] and ((label_a[i] == label[j] and i != j) if seed % 2 else label_a[i] != label[j])]
            want += [(i * ranges + t, -s, v) for s, v in sorted(fits)[:k]]
    assert list(zip(*(x.tolist() for x in (anchors.found[0], anchors.found[1], anchors.found[3])))) == want


def test_planes_drop_candidates():
    """Most pairs go before their last planes are read."""
    r = np.random.default_rng(3)
    q = np.floor(256 * r.normal(0, 0.125, (4000, 64))).astype(np.int64)
    anchors = bitslices.Anchors(np.arange(50), np.zeros(50), q[:50], np.full((50, 1), -(1 << 62)), np.full((50, 1), 1 << 62), 10, False)
    for at in range(0, 4000, 1000):
        c = slice(at, at + 1000)
        bitslices.search_tile(anchors, np.arange(4000)[c], np.arange(4000)[c], np.zeros(1000, dtype=np.int64), np.ones(1000), q[c], 9)
    assert anchors.pairs_read < 50 * 4000 / 4


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    got = queries.op13_bit_sliced_negatives(spark, "/root/testdata/sf0.001")
    answer = sorted(con.execute(queries.ORACLE_SQL["op13_bit_sliced_negatives"]).fetchall())
    assert answer and sorted(map(tuple, got.collect())) == answer
