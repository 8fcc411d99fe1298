"""Near copies against brute-force Jaccard over five-word shingles."""

import random

from millrace.llm import jaccard

import corpus_pipeline


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near_groups(texts):
    """Smallest index reachable over pairs of similarity 0.8, by brute force."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def near_rows(n: int = 400) -> list[tuple]:
    """Many edits of one text, of few and many words, as a crowd and its strays; pairs; and unrelated texts with a common line."""
    r = random.Random(21)
    say = lambda k: [f"w{r.randint(0, 10**6)}" for _ in range(k)]
    base, line, texts = say(150), say(12), []
    for k in range(n):
        words = list(base) if k % 2 else say(r.randint(3, 120)) + line
        if k % 2:
            for _ in range(r.randint(0, 9)):
                words[r.randrange(len(words))] = f"e{r.randint(0, 10**6)}"
        if k % 10 == 0 and k:
            words = texts[-2].split()
            for _ in range(r.randint(1, 2)):
                words[r.randrange(len(words))] = "x"
        texts.append(" ".join(words))
    return [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts + ["", None, "a b", "A B", "one"])]


def test_near_copies_equal_brute_force(spark):
    rows = near_rows()
    want = near_groups([r[1] for r in rows])
    assert 12 < len({g for g in want if want.count(g) > 1}) and max(map(want.count, want)) > 60
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for dense in (2, 10_000):
        got = {r.doc_id: r.component_id for r in jaccard.near_copies(df, dense=dense).collect()}
        assert [got[k] for k in range(len(rows))] == want
    # the sample only orders the shingles
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(df, sample_rows=20, dense=8).collect()}
    assert [got[k] for k in range(len(rows))] == want


def test_sketches_never_tell_more_differences_than_there_are():
    import numpy as np

    rng = np.random.default_rng(8)
    for _ in range(300):
        base = rng.integers(0, 2**64, rng.integers(0, 700), dtype=np.uint64)
        a, b = (np.unique(np.concatenate((base[: rng.integers(0, len(base) + 1)], rng.integers(0, 2**64, rng.integers(0, 300), dtype=np.uint64)))) for _ in range(2))
        apart = len(np.setxor1d(a, b))
        got = jaccard.differences(jaccard.sketch(a), jaccard.sketch(b))
        assert got <= apart and (got - apart) % 2 == 0


def test_blocks_give_out_what_single_pairs_would():
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    sets = []
    for _ in range(120):
        cut = base[: rng.integers(150, 301)] if rng.random() < 0.5 else base.copy()
        cut = np.concatenate((cut[rng.random(len(cut)) > rng.choice([0.0, 0.03, 0.1])], rng.integers(0, 2**64, rng.integers(0, 30), dtype=np.uint64)))
        sets.append(np.unique(cut))
    rows = np.array([(k, len(x), rng.integers(0, 20), rng.integers(0, 9)) for k, x in enumerate(sets)])
    few, many = (rows[:50], [jaccard.sketch(x) for x in sets[:50]]), (rows, [jaccard.sketch(x) for x in sets])
    want = set()
    for a in range(50):
        for b in range(120):
            n, m = len(sets[a]), len(sets[b])
            by_place = 9 * min(n - rows[a, 2], m - rows[b, 2]) >= 4 * (n + m)
            by_sketch = 9 * (n + m - jaccard.differences(few[1][a], many[1][b])) >= 8 * (n + m)
            if by_place and by_sketch and rows[a, 3] != rows[b, 3]:
                want.add((a, b))
    for at_once in (1 << 22, 1000):
        got = [tuple(r) for r in jaccard._near_by_sketch(few, many, at_once).tolist()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_near_dedup_stage_removes_near_copies(spark):
    rows = near_rows(120)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = near_groups([r[1] for r in rows])
    got = corpus_pipeline.simhash_near_dedup(spark, df, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want))


def test_rows_without_ids_and_no_rows(spark, docs, rows, no_docs):
    kept = jaccard.keep_one_near(docs)
    assert kept.columns == docs.columns
    distinct = sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0))
    want = {distinct[g][0] for g in near_groups([t for _, t in distinct])}
    # one row of each group, though some rows repeat entirely
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == sorted(want, key=str)
    assert jaccard.keep_one_near(no_docs).count() == 0


def test_one_of_rows_that_repeat_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(7, text, "a")] * 300 + [(7, text, "b")] * 3 + [(None, "alone " * 9, "c")] * 5 + [(None, text + " more", "d"), (9, None, "e"), (8, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(4)
    got = sorted(((r.doc_id, r.text) for r in jaccard.keep_one_near(df).collect()), key=str)
    assert got == sorted([(7, text), (None, "alone " * 9), (8, "")], key=str)


def test_pairs_of_a_key_come_whatever_the_batches():
    import numpy as np
    import pyarrow as pa

    rows = [(1, k // 9, 100 + k, 100) for k in range(50)] + [(2, 0, 5, 100), (3, 0, 5, 100), (3, 1, 6, 100), (3, 90, 7, 100), (4, 0, 9, 10), (5, 0, 1, 10), (5, 0, 1, 10)]
    table = np.array(rows, dtype=np.int64)
    want = sorted((min(x[2], y[2]), max(x[2], y[2])) for k, x in enumerate(rows) for y in rows[:k] if x[0] == y[0] and x[2] != y[2] and 9 * min(x[3] - x[1], y[3] - y[1]) >= 4 * (x[3] + y[3]))
    for size in (1, 3, 7, 100):
        batches = [pa.record_batch([pa.array(c) for c in table[k : k + size].T], names=["key", "place", "node", "n"]) for k in range(0, len(table), size)]
        assert sorted(tuple(r.values()) for b in jaccard._groups(iter(batches)) for r in b.to_pylist()) == want
    assert list(jaccard._groups(iter([]))) == []


def test_a_crowd_of_strays_that_share_one_rare_shingle(spark):
    """Texts of many sizes with one run of five words in common, and near copies between some of them, in small blocks."""
    import random

    r = random.Random(6)
    say = lambda n: [f"w{r.randrange(50_000)}" for _ in range(n)]
    rows = []
    for k in range(160):
        own = say(r.choice([20, 30, 60, 75, 200])) + ["one", "rare", "run", "of", "words"] + say(r.choice([5, 40]))
        rows.append((2 * k, " ".join(own), "en", "s", 0))
        if k % 9 == 0:  # a word more at the end
            rows.append((2 * k + 1, " ".join([*own, "more"]), "en", "s", 0))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids, groups = [x[0] for x in rows], near_groups([x[1] for x in rows])
    smallest = {}
    for doc_id, g in zip(ids, groups):
        smallest[g] = min(doc_id, smallest.get(g, doc_id))
    for block in (7, 2048):
        got = {x.doc_id: x.component_id for x in jaccard.near_copies(df, dense=8, block=block).collect()}
        assert got == {doc_id: smallest[g] for doc_id, g in zip(ids, groups)} and len(set(got.values())) < len(rows)


def test_fingerprints_link_near_copies(spark):
    """Texts that are equal but for one word, by SimHash alone, as brute force over fingerprints and Jaccard has them."""
    from millrace.llm import simhash
    from pyspark.sql import functions as F

    r = random.Random(14)
    texts = []
    for k in range(40):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(r.choice([300, 600, 1200]))]
        texts += [" ".join(base), " ".join([*base, "more"]), " ".join([*base[:40], "x", *base[41:]])]
    texts += ["", "a b c", "A b C d e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = jaccard.prefixes(df, jaccard.common_shingles(df, "text", 100)).withColumn("node", F.col("doc_id"))
    fps = {x.doc_id: x.fp for x in rows.select("doc_id", "fp").collect()}
    assert all(fps[k] % 2**64 == simhash._fingerprint(t.encode(), jaccard.SHINGLE, jaccard.SEED) for k, t in enumerate(texts))
    sets = [shingles(t) for t in texts]
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    close = {(a, b) for b in range(len(texts)) for a in range(b) if ((fps[a] ^ fps[b]) % 2**64).bit_count() <= 2}
    got = {(x.a, x.b) for x in jaccard.fingerprint_links(rows, df).collect()}
    assert got <= {(a, b) for a, b in close if near(a, b)} and len(got) > 20
    label = list(range(len(texts)))
    for a, b in sorted(got) * 3:
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    assert all(label[a] == label[b] for a, b in close if near(a, b))
