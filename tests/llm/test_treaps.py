import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from millrace.llm import queries, treaps
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, k):
    """Counter of (item_id, rank, doc_id, score) over all documents."""
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    documents, tokens = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item_id, text in items:
        scored = []
        for doc_id, counted, n in held:
            score = 0
            for t in terms(text):
                if t in counted:
                    w, tf, m = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))), counted[t], 100 - 25 + (25 * n * documents) // tokens
                    score += w * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, null, doc_id) in enumerate(sorted(scored)[:k], 1):
            out[item_id, rank, None if null else doc_id, -score] += 1
    return out


def test_terms():
    r = random.Random(4)
    for _ in range(500):
        text = "".join(r.choice("aZ09 _-\x00\x7f\x80\xa0é日😀İſ\n\t@[`{") for _ in range(30))
        assert [t.decode() for t in treaps.terms_of(text.encode())] == terms(text), repr(text)


@pytest.mark.parametrize("seed", range(25))
def test_a_treap_is_a_search_tree_and_a_heap(seed):
    r = random.Random(seed)
    n, n_terms = r.choice([0, 1, 40, 3000]), r.choice([1, 3, 50])
    pairs = sorted({(r.randrange(n_terms), r.randrange(n)) for _ in range(n * 2)}, key=lambda x: x[1])
    impact = [r.choice([0, 5, 5, 5, r.randrange(10**9)]) for _ in pairs]
    found = treaps.Treaps(np.array([t for t, _ in pairs], dtype=np.int32), np.array([d for _, d in pairs], dtype=np.int64), np.array(impact, dtype=np.int64))
    want = {(t, d): i for (t, d), i in zip(pairs, impact)}
    seen, deepest = {}, 0
    for term, root in found.roots.items():
        # node, documents that it may have, largest impact that it may have, depth
        todo = [(root, -1, n, 1 << 60, 1)]
        while todo:
            node, low, high, most, depth = todo.pop()
            if node >= 0:
                d, i = int(found.doc[node]), int(found.impact[node])
                assert low < d < high and i <= most
                seen[term, d], deepest = i, max(deepest, depth)
                todo += [(found.left[node], low, d, i, depth + 1), (found.right[node], d, high, i, depth + 1)]
    assert seen == want and deepest < 60  # runs of equal impacts make no chains


@pytest.mark.parametrize("seed", range(40))
def test_traversal_equals_scoring_all(seed):
    r = random.Random(100 + seed)
    n, n_terms = r.choice([1, 30, 2000]), r.choice([1, 5, 30])
    pairs = sorted({(r.randrange(n_terms), r.randrange(n)) for _ in range(n * 3)}, key=lambda x: x[1])
    impact = [r.choice([0, 7, 7, r.randrange(100), r.randrange(10**6)]) for _ in pairs]
    made = treaps.Treaps(np.array([t for t, _ in pairs]), np.array([d for _, d in pairs]), np.array(impact))
    for _ in range(10):
        query, k = {r.randrange(n_terms + 3): r.randint(1, 3) for _ in range(r.randint(0, 8))}, r.choice([1, 3, 20])
        total = Counter()
        for (t, d), i in zip(pairs, impact):
            total[d] += i * query.get(t, 0)
        want = sorted((-s, d) for d, s in total.items() if s > 0)[:k]
        scores, docs, scored = made.best(query, k, step=r.choice([16, 4096]))
        assert list(zip((-scores).tolist(), docs.tolist())) == want and scored <= len(total)
        if want:
            floor = r.choice([-want[0][0], -want[-1][0], 1])
            scores, docs, _ = made.best(query, k, floor)
            assert list(zip((-scores).tolist(), docs.tolist())) == [x for x in want if -x[0] >= floor]


def test_subtrees_are_pruned():
    r = np.random.default_rng(1)
    doc = np.sort(np.concatenate([r.choice(50_000, 10_000, replace=False) for _ in range(8)]))
    term, impact = r.integers(0, 8, len(doc)), r.integers(1, 1000, len(doc)) ** 3
    once = np.unique(np.c_[doc, term], axis=0, return_index=True)[1]
    made = treaps.Treaps(term[once], doc[once], impact[once])
    assert made.best({0: 1, 1: 1, 2: 1}, 10)[2] < 2500  # of some 25,000 documents with a term


@pytest.mark.parametrize("bounds", [{}, {"block_rows": 7, "block_postings": 50}, {"terms_per_pass": 9}])
def test_ranked_search(spark, docs, rows, no_docs, bounds):
    asked = [(1, rows[3][1]), (2, rows[7][1]), (2, "ab ab ab"), (3, None), (None, rows[0][1]), (4, "  \n"), (5, "nowhere"), (6, rows[3][1].upper()), (1, rows[3][1]), (7, " ".join(t for r in rows[:20] for t in terms(r[1])))]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumn("terms", F.lit("clash"))
    got = Counter(map(tuple, treaps.ranked_search(docs, items, k=4, **bounds).collect()))
    assert got == brute([(r[0], r[1]) for r in rows], asked, 4)
    assert treaps.ranked_search(no_docs, items).count() == 0 and treaps.ranked_search(docs, items.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = queries.op12_inverted_treaps(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLE_SQL["op12_inverted_treaps"]).fetchall())
