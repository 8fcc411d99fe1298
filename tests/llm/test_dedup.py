import hashlib
import random
from collections import Counter

import numpy as np
from millrace.llm import decontam, simhash, substring
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest


def repeats(rows, window):
    """Brute force: the first place of each window stays, in order of doc_id (null last)."""
    texts = sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is None, x[0] or 0))
    seen, out = {}, {}
    for doc_id, text in texts:
        words = text.encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[k : k + window]), (doc_id, k)) != (doc_id, k):
                gone[k : k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(docs, rows, no_docs):
    want = repeats(rows, 20)
    assert sum(v[1] for v in want.values()) > 100
    for seed, crowd in ((5, 1000), (10, 1000), (10, 1), (5, 3)):
        got = substring.remove_repeats(docs, 20, seed, crowd=crowd).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert substring.remove_repeats(no_docs).count() == 0


def test_substring_dedup_inside_one_text_and_in_random_ones(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(50)] + [(90, "x " * 300)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 8, 2).collect()
    want = repeats(rows, 8)
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in got} == want


def test_texts_without_repeats_keep_their_columns(docs, rows):
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns
    want, texts = repeats(rows, 20), {r[0]: r[1] for r in rows}
    for r in out.select("doc_id", "text", "lang", "key").collect():
        n, gone, sha = want[r.doc_id]
        assert r.key == "clash"
        if gone:
            assert hashlib.sha256(r.text.encode()).hexdigest() == sha
        else:
            assert r.text == texts[r.doc_id]


def test_thousands_of_equal_rows_are_one_document(spark):
    r = random.Random(6)
    text = " ".join(f"w{r.randint(0, 999)}" for _ in range(400))
    rows = [(5, text)] * 3000 + [(None, text + " end")] * 1500 + [(4, "x " + text[:200]), (6, text), (6, text), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.monotonically_increasing_id()).repartition(5)
    want = repeats(rows, 20)
    got = Counter((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substring.remove_repeats(df).collect())
    assert got == Counter((d, *want[d]) for d, _ in rows)
    out = substring.without_repeats(df)
    assert out.columns == df.columns and out.select("n").distinct().count() == len(rows)
    assert {x.doc_id: x.n for x in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == dict(Counter(d for d, _ in rows))
    assert out.filter("doc_id = 7 AND text IS NULL").count() == 1


def test_reducers_stream_over_batches():
    """However a partition is cut into batches, the same runs and windows are found."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 400
    key, doc, at = np.sort(rng.integers(0, 150, n)), rng.integers(0, 9, n), rng.integers(0, 50, n)
    state = rng.choice([0, 0, 0, 1, 2], n)
    at = np.where(state == 2, 2, at)
    total = {k: sum(2 if s == 2 else s == 0 for s in state[key == k]) for k in set(key.tolist())}
    want = Counter((d, a) for k, d, a, s in zip(key.tolist(), doc.tolist(), at.tolist(), state.tolist()) if s == 1 or s == 0 and total[k] > 1)
    for size in (1, 2, 7, 1000):
        cols = [key, doc, np.zeros(n, dtype=np.int64), at.astype(np.int32), state.astype(np.int8)]
        batches = [pa.record_batch([pa.array(c[k : k + size]) for c in cols], names=["key", "doc", "sub", "at", "state"]) for k in range(0, n, size)]
        out = [r for b in substring._repeated(3)(iter(batches)) for r in b.to_pylist()]
        assert Counter((r["doc"], r["at"]) for r in out if r["place"] is None) == want
        assert any(r["place"] is not None for r in out) == (max(total.values()) > 3)


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def groups(values, distance):
    """Smallest index reachable over links, by brute force."""
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_fingerprints_are_of_seeded_xxh64(spark, docs, rows):
    got = Counter((r.doc_id, r.fp) for r in simhash.fingerprints(docs).collect())
    assert got == Counter((r[0], simhash._signed(fingerprint(r[1]))) for r in rows)
    word = spark.sql("SELECT xxhash64('a b c')").first()[0]
    assert word % 2**64 == xxh64_intdigest(b"a b c", 42)


def test_near_duplicates(docs, rows, no_docs):
    distinct = sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0))
    values = [fingerprint(t) for _, t in distinct]
    want = {d: (f"{v:016x}", distinct[g][0]) for (d, _), v, g in zip(distinct, values, groups(values, 2))}
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.fingerprint, r.component_id) == want[r.doc_id]
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == sorted((d for d, (_, c) in want.items() if d == c), key=str)


def test_links_of_crowded_and_sparse_values_agree(spark):
    r = random.Random(9)
    centre = r.getrandbits(64)
    values = {centre, 0, 1, 3, 7}
    while len(values) < 250:
        base = r.choice([centre, r.getrandbits(64)])
        for b in r.sample(range(64), r.randint(0, 4)):
            base ^= 1 << b
        values.add(base)
    values = sorted(values, key=simhash._signed)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long").withColumn("x", F.lit(1))
    for distance in (1, 2):
        want = groups(values, distance)
        for dense in (2, 10_000):
            edges = simhash.links(df.select("fp"), distance, dense=dense)
            for e in edges.collect():
                assert ((e.a ^ e.b) & (2**64 - 1)).bit_count() <= distance
            labels = {x.node: x.label for x in simhash.components(edges).collect()}
            assert [labels.get(simhash._signed(v), simhash._signed(v)) for v in values] == [simhash._signed(values[g]) for g in want]


def test_allocation_keeps_the_pigeonhole():
    rng = np.random.default_rng(1)
    for total in (100, 10**6, 10**11):
        sample = rng.integers(0, 2**63, 300).astype(np.uint64)
        parts = simhash.allocate(sample, total)
        assert sum(p.threshold + 1 for p in parts) == 3
        bits = [b for p in parts for b in p.bits]
        assert len(bits) == len(set(bits))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 900), (500, 901)], "a long, b long")
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 900: 500, 901: 500}


def test_greedy_tiles():
    item = np.arange(20, dtype=np.uint64)
    text = np.concatenate((np.arange(10, 20), [77, 78], np.arange(0, 10), [99], np.arange(3, 8))).astype(np.uint64)
    tiles = decontam.greedy_tiles(text, item, 5)
    assert sorted(tiles) == [(0, 10, 10), (12, 0, 10)]
    assert decontam.greedy_tiles(text, item, 11) == []
    # brute force: longest first, never overlapping
    r = random.Random(3)
    for _ in range(200):
        a, b = (np.array([r.randint(0, 3) for _ in range(r.randint(0, 25))], dtype=np.uint64) for _ in range(2))
        free_a, free_b, want = [True] * len(a), [True] * len(b), 0
        while True:
            best = (0, 0, 0)
            for i in range(len(b)):
                for t in range(len(a)):
                    n = 0
                    while t + n < len(a) and i + n < len(b) and a[t + n] == b[i + n] and free_a[t + n] and free_b[i + n]:
                        n += 1
                    best = max(best, (n, -i, -t))
            if best[0] < 3:
                break
            n, i, t = best[0], -best[1], -best[2]
            free_a[t : t + n], free_b[i : i + n] = [False] * n, [False] * n
            want += n
        assert sum(n for *_, n in decontam.greedy_tiles(a, b, 3)) == want


def test_tiles_of_words_that_repeat():
    import time

    began = time.perf_counter()
    same = np.zeros(20_000, dtype=np.uint64)
    assert decontam.greedy_tiles(same, same[:1000], 5) == [(0, 0, 1000)]
    r = random.Random(1)
    item = np.array([r.randint(0, 1) for _ in range(1000)], dtype=np.uint64)
    text = np.array([r.randint(0, 1) for _ in range(20_000)], dtype=np.uint64)
    assert sum(n for *_, n in decontam.greedy_tiles(text, item, 5)) >= 900  # gaps between tiles are under five words
    broken = np.tile(np.append(np.zeros(30), 1), 600).astype(np.uint64)
    assert sum(n for *_, n in decontam.greedy_tiles(broken, same[:1000], 5)) == 1000
    assert time.perf_counter() - began < 60


def test_closed_places_are_not_covered():
    words, closed = decontam._closed_words(np.arange(12), np.array([5, 12]))
    assert words[~closed].tolist() == list(range(12)) and np.flatnonzero(closed).tolist() == [5, 13]
    assert sorted(decontam.greedy_tiles(words, np.arange(12, dtype=np.uint64), 3, closed)) == [(0, 0, 5), (6, 5, 7)]


def test_decontamination_equals_tiling_all_pairs(spark):
    """Many documents and items that share common lines and one another's parts, against tiles of every pair."""
    r = random.Random(12)
    say = lambda k: [f"w{r.randint(0, 10**6)}" for _ in range(k)]
    line, other = say(12), say(8)
    items = [say(r.randint(6, 30)) + r.choice([line, [], other]) for _ in range(25)] + [line, other + line, ["buy"] * 40]
    texts = []
    for k in range(120):
        parts = [say(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            own = r.choice(items)
            a = r.randint(0, len(own) // 2)
            parts += [own[a : a + r.randint(len(own) // 3, len(own))], say(r.randint(0, 3)), line if k % 3 == 0 else []]
        texts.append([w for p in parts for w in p])
    texts.append(["buy"] * 300)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)] + [(3, " ".join(texts[3]))], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    number = {w: k for k, w in enumerate({w for t in texts + items for w in t})}
    code = lambda t: np.array([number[w] for w in t], dtype=np.uint64)
    for coverage in (0.5, 0.8):
        want = Counter()
        for d, t in [*enumerate(texts), (3, texts[3])]:
            for i, item in enumerate(items):
                tiles = decontam.greedy_tiles(code(t), code(item), 5)
                matched = sum(n for *_, n in tiles)
                if matched and matched >= coverage * len(item):
                    want[d, i, len(item), matched, len(tiles)] += 1
        got = decontam.overlaps(docs, bench, coverage=coverage).collect()
        assert Counter((x.doc_id, x.item_id, x.n_tokens, x.n_matched, x.n_tiles) for x in got) == want and len(want) > 40


def test_decontamination(spark, docs, rows, no_docs):
    r = random.Random(8)
    say = lambda k: [f"w{r.randint(0, 10**6)}" for _ in range(k)]
    items = [say(30), say(40), say(3), []]
    moved = items[1][20:] + say(4) + items[1][:20]
    texts = [
        (2000, " ".join(say(50) + items[0] + say(9)).upper()),
        (2001, " ".join(moved).replace("w", "W").replace(" ", ", ")),
        (2002, " ".join(items[0][:12] + say(30))),
        (2003, " ".join(items[2] + say(10))),
        (2004, " ".join(items[0] + items[1])),
        (None, " ".join(say(3) + items[1])),
    ]
    extra = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(None, None)], "item_id long, text string").withColumn("t", F.lit(1))
    both = docs.unionByName(extra, allowMissingColumns=True)
    want = {(2000, 0), (2001, 1), (2004, 0), (2004, 1), (None, 1)}
    got = decontam.overlaps(both, bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == 5
    tiles = {x.doc_id: x.n_tiles for x in got if x.item_id == 1}
    assert tiles[2001] == 2 and all(x.coverage == 1.0 for x in got)
    # items in blocks, each with a filter and a reading of its own
    parts = decontam._contaminated(both, bench, 5, 0.5, seeds_per_pass=30).drop("t0", "t1")
    assert sorted(map(str, parts.select(*decontam.overlaps(both, bench).columns).collect())) == sorted(map(str, decontam.overlaps(both, bench).collect()))
    kept = decontam.keep_clean(both, bench)
    assert kept.columns == both.columns and kept.count() == both.count() - 4
    assert decontam.overlaps(no_docs, bench).count() == 0
    assert decontam.overlaps(docs, bench.limit(0)).count() == 0
