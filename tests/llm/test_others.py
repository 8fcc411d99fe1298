import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
from millrace.llm import quality, sharding, toxicity, warc
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(k, k + 5))
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_upper": sum("A" <= c <= "Z" for c in text), "n_marks": sum(c in "!?" for c in text),
    }


def test_statistics(spark, docs, rows):
    texts = [r[1] for r in rows] + ["a b c d e a b c d e a", "x\nx\n\n \nx y\nx y", "one two " * 40, "#*|<> & A!?", "a b c d e", "é ß 日本 \x1c"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    for r in df.select("k", quality.statistics().alias("s")).collect():
        assert r.s.asDict() == stats(texts[r.k]), texts[r.k]


def test_quality_rules(spark, docs, rows, no_docs):
    good = [(k, " ".join(f"w{(k * 37 + j * 11) % 91}" for j in range(30 + k % 20)), 1) for k in range(200)]
    bad = [(300 + k, " ".join(f"w{(k * 31 + j * 7) % 83}###" for j in range(30 + k % 20)), 0) for k in range(80)]
    loud = [(500 + k, " ".join(f"W{(k * 29 + j * 13) % 89}AB!!" for j in range(30 + k % 20)), 0) for k in range(80)]
    df = spark.createDataFrame([(d, t) for d, t, _ in good + bad + loud] + [(900, "short"), (901, None), (902, "say it so " * 30)], "doc_id long, text string").withColumn("_s", F.lit(1)).withColumn("bad", F.lit(1))
    labels = spark.createDataFrame([(d, q) for d, _, q in good + bad + loud] + [(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    rules = quality.learn_rules(quality.labelled_sample(df, labels))
    assert 1 <= len(rules) <= 4 and all(1 <= len(r) <= 3 for r in rules)
    got = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    for d, t, q in good + bad + loud:
        assert got[d].kept or not q, d
        assert {k: got[d][k] for k in quality.STATISTICS} == stats(t)
    assert all(got[d].base_failed and not got[d].kept for d in (900, 901, 902))
    assert sum(got[d].kept for d, _, _ in bad + loud) <= 8
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got.values())
    # a bound on the sample, no labels, and no documents
    assert len(quality.learn_rules(quality.labelled_sample(df, labels, bound=120))) >= 1
    assert quality.judge(docs, labels.limit(0)).filter("kept = base_failed").count() == 0
    assert quality.judge(no_docs, labels).count() == 0


def test_rules_are_what_brute_force_covering_finds(spark):
    """Two planted conjunctions of two thresholds each, over noise: no single threshold is enough."""
    import math
    import random

    r = random.Random(4)
    rows = []
    for k in range(3000):
        x, y, z = r.randint(0, 19), r.randint(0, 19), r.randint(0, 19)
        rows.append((int(x > 11 and y <= 7 or y > 14 and z <= 4), int(k % 3 == 0), float(x), float(y), float(z)))
    df = spark.createDataFrame(rows, "bad int, fold int, x double, y double, z double")
    rules = quality.learn_rules(df, max_literals=2, min_covered=3)
    holds = lambda rule, row: all((row[2 + "xyz".index(l.feature)] > l.cut) == l.above for l in rule)  # noqa: E731,E741

    def grown(left):
        """The best literal by FOIL's gain, then the best of those that go with it."""
        found = []
        for _ in range(2):
            own = [t for t in left if t[1] == 0 and all((t[2 + f] > c) == above for f, above, c in found)]
            p0 = sum(t[0] for t in own)
            best = (0.0, None)
            for f in range(3):
                for above in (False, True):
                    for c in range(19):
                        q = [t[0] for t in own if (t[2 + f] > c) == above]
                        if sum(q):
                            gain = sum(q) * (math.log2(sum(q) / len(q)) - math.log2(p0 / len(own)))
                            best = max(best, (gain, (f, above, float(c))), key=lambda v: v[0])
            if best[1] is None:
                break
            found.append(best[1])
        return found

    left = rows
    for rule in rules:
        assert [("xyz".index(l.feature), l.above, l.cut) for l in rule] == grown(left)  # noqa: E741
        left = [t for t in left if not holds(rule, t)]
    assert len(rules) >= 2 and all(len(rule) == 2 for rule in rules[:2])
    assert sum(t[0] for t in left) == 0 and not any(holds(rule, t) for rule in rules for t in rows if not t[0])


def test_samples_are_bounded_in_rows_and_always_the_same(spark):
    rows = [(k % 40, f"text {k % 400} " + " ".join(f"w{j}" for j in range(12))) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
    taken = []
    for parts in (2, 5):
        sample = toxicity.training_rows(df.repartition(parts), labels, bound=25)
        assert sample.count() == 25
        taken.append(sorted((r._id, r._tie) for r in sample.collect()))
        assert quality.labelled_sample(df.repartition(parts), labels, bound=30).count() == 30
    assert taken[0] == taken[1]


def test_scores_are_the_naive_sum_over_pairs(spark):
    rng = np.random.default_rng(5)
    buckets = np.sort(rng.choice(3 * toxicity.BUCKETS, 40, replace=False))
    machine = toxicity.Machine(0.3, buckets, rng.normal(size=40).astype(np.float32), rng.normal(size=(40, 4)).astype(np.float32))
    texts = [rng.choice(45, rng.integers(0, 20), replace=False) for _ in range(30)]  # 40 and more are unknown
    values = np.concatenate([np.where(t < 40, np.append(buckets, [7] * 5)[t], 7) for t in texts]).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = machine.raw(machine.table()[values], offsets)
    for t, raw in zip(texts, got):
        own = [k for k in t if k < 40]
        want = 0.3 + sum(float(machine.weights[k]) for k in own)
        want += sum(float(machine.factors[a] @ machine.factors[b]) for i, a in enumerate(own) for b in own[:i])
        assert abs(raw - want) < 1e-4


def test_kd_tree_shards(spark, docs, rows, no_docs):
    got = sharding.kd_tree_shards(docs, 4).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    for s in range(4):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.kd_tree_shards(no_docs, 4).count() == 0


def test_kd_tree_shards_are_even(spark):
    # a third of the rows share every coordinate
    rows = [(7 if k % 3 == 0 else k, "x" * (10 + k * 7919 % 190), "en", "s", 5 if k % 3 == 0 else k) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes = [r.b for r in sharding.kd_tree_shards(df, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8
    assert max(sizes) - min(sizes) <= 4 * 201


def tree(points, leaves, dims, whole):
    """Shards in order, by cutting lists of (coordinates, size) with different coordinates one by one."""
    if leaves == 1:
        return [points]
    if not points:
        return [[] for _ in range(leaves)]
    span = lambda d: (max(p[0][d] for p in points) - min(p[0][d] for p in points)) / whole[d]
    d = max(range(dims), key=span)
    points = sorted(points, key=lambda p: p[0][d])
    lower = leaves - leaves // 2
    goal, total, k = sum(p[1] for p in points) * lower / leaves, 0, 0
    while total + points[k][1] < goal:
        total, k = total + points[k][1], k + 1
    # the document at the place goes to the side that it leaves nearer to its share
    k += total + points[k][1] - goal <= goal - total
    return tree(points[:k], lower, dims, whole) + tree(points[k:], leaves // 2, dims, whole)


def test_kd_tree_is_what_cutting_one_by_one_gives(spark):
    import random

    for seed, shards, target in ((1, 3, None), (2, 5, None), (3, 8, None), (4, 13, None), (5, None, 2000), (6, 1, None)):
        r = random.Random(seed)
        n = 150
        ids, chars = r.sample(range(-5000, 5000), n), r.sample(range(100_000), n)
        rows = [(i, "x" * r.choice([0, 3, 90, 700]), "en", "s", c) for i, c in zip(ids, chars)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        got = sharding.kd_tree_shards(df, shards, target, textual=()).collect()
        sizes = {i: len(t) + 1 for i, t, *_ in rows}
        leaves = shards or -(-sum(sizes.values()) // target)
        whole = [max(x) - min(x) for x in (ids, chars)]
        want = tree([((i, c), sizes[i]) for i, *_, c in rows], leaves, 2, whole)
        by_shard = [sorted(x.doc_id for x in got if x.shard == k) for k in range(leaves)]
        assert by_shard == [sorted(p[0][0] for p in leaf) for leaf in want]
        assert all(sorted(x.slot for x in got if x.shard == k) == list(range(len(by_shard[k]))) for k in range(leaves))
        assert len(rows) == len(got) and all(sizes[x.doc_id] == x["size"] for x in got)


def test_kd_tree_splits_the_widest_dimension(spark):
    df = spark.createDataFrame([(k, "x" * 9, "en", "s", 50) for k in range(64)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sharding.kd_tree_shards(df, 8).orderBy("doc_id").collect()
    assert [r.shard for r in got] == [k // 8 for k in range(64)]


def test_slots_over_many_parts(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("text_crc32"), (F.col("id") % 3 == 0).cast("int").alias("shard"))
    got = sharding._with_slots(df, 2, rows_per_part=50).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()
    assert all(r.n == r.d == r.hi + 1 and r.lo == 0 for r in got)


def pages(spark):
    rows = [(1, "http://a\r\nX: y", "<p>ä</p>"), (2, "http://b", "<p>ä</p>"), (5, None, None), (6, "u", ""), (3, "c", "<p>ä</p>"), (4, "d", "once"), (None, "e", "<p>ä</p>"), (9, "f", "twice"), (9, "f", "twice"), (None, "g", "lone"), (10, "h", "long" * 9000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("address", F.lit("clash")).withColumn("payload", F.lit(1))


def b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archive(spark, tmp_path):
    rows, df = pages(spark)
    for least in (0, 9):
        path = str(tmp_path / f"archive{least}")
        warc.write_archive(df, path, least)
        got = Counter(map(tuple, warc.read_index(spark, path).collect()))
        want = Counter()
        for page_id, _, html in rows:
            data = (html or "").encode()
            top = max((r[0] for r in rows if (r[2] or "").encode() == data and r[0] is not None), default=None)
            revisit = len(data) >= least and top is not None and page_id != top
            want[(page_id, len(data), b32(data), "revisit" if revisit else "response", top if revisit else None)] += 1
        assert got == want
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({r[2] or "" for r in rows})
    whole = warc.read_records(spark, path).collect()
    assert Counter((r.page_id, bytes(r.payload)) for r in whole) == Counter((p, (h or "").encode()) for p, _, h in rows)
    for r in whole:
        record, payload = bytes(r.record), bytes(r.payload)
        head, _, block = record.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and fields["WARC-Payload-Digest"] == f"sha1:{b32(payload)}"
        # a response's block is the HTTP response, of which the body is the payload
        http, _, body = block[:-4].partition(b"\r\n\r\n")
        assert int(fields["Content-Length"]) == len(block) - 4
        assert block[:-4] == b"" if fields["WARC-Type"] == "revisit" else (http.startswith(b"HTTP/1.1 200 OK\r\n") and http.endswith(b": %d" % len(payload)) and body == payload)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_archive_notices_changed_bytes(spark, tmp_path):
    import pytest

    path, other = str(tmp_path / "a"), str(tmp_path / "b")
    warc.write_archive(pages(spark)[1], path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")).write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    with pytest.raises(Exception, match="do not match their address"):
        warc.read_index(spark, other).collect()
    # a header whose length is not that of the record put together
    longer = str(tmp_path / "c")
    spark.read.parquet(f"{path}/payloads").write.parquet(f"{longer}/payloads")
    spark.read.parquet(f"{path}/headers").withColumn("header", F.encode(F.concat(F.decode("header", "UTF-8"), F.lit("x")), "UTF-8")).write.parquet(f"{longer}/headers")
    with pytest.raises(Exception, match="do not add up"):
        warc.read_index(spark, longer).collect()


def test_factorization_machine_learns_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(1600):
        a, b = rng.integers(0, 2, 2)
        noise = " ".join(f"n{x}" for x in rng.integers(0, 40, 6))
        rows.append((k, f"{'alpha' if a else 'beta'} {'gamma' if b else 'delta'} {noise}", int(a == b)))
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    # neither word tells anything alone
    machine = toxicity.fit(toxicity.training_rows(df, labels), epochs=60, association=-1.0, rate=0.3, decay=0.0)
    got = {r.doc_id: r for r in toxicity.score(df, machine).collect()}
    held = [(got[k].predicted, y) for k, _, y in rows if got[k].held_out]
    assert len(held) > 200 and np.mean([p == y for p, y in held]) > 0.9


def test_pairs_are_learned_as_score_toxicity_fits(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(1600):
        a, b = rng.integers(0, 2, 2)
        noise = " ".join(f"n{x}" for x in rng.integers(0, 40, 6))
        rows.append((k, f"{'alpha' if a else 'beta'} {'gamma' if b else 'delta'} {noise}", int(a == b)))
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, labels).collect()}
    held = [(got[k].predicted, y) for k, _, y in rows if got[k].held_out]
    assert len(held) > 200 and np.mean([p == y for p, y in held]) > 0.9


def test_score_toxicity(spark, docs, rows, no_docs):
    marked = [(d, f"{t or ''} you idiot" if d and d % 3 == 0 else t) for d, t in {r[0]: r[1] for r in rows}.items()]
    df = spark.createDataFrame(marked * 1, "doc_id long, text string").withColumn("terms", F.lit(1))
    labels = spark.createDataFrame([(d, int(d % 3 == 0)) for d, _ in marked if d is not None], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, labels).collect()}
    assert len(got) == len(marked)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    seen = [got[d] for d, _ in marked if d is not None and d % 3 == 0]
    assert np.mean([r.predicted for r in seen]) > 0.9
    assert toxicity.score_toxicity(no_docs, labels).count() == 0
    alone = toxicity.score_toxicity(docs, labels.filter("toxic = 0")).collect()
    assert len(alone) == len(rows) and len({r.score for r in alone}) == 1
