import random

import pytest
from millrace.operators import folds


def numbered(spark, rows, names):
    return spark.createDataFrame([(0, k, *r) for k, r in enumerate(rows)], f"g int, k int, {names}")


def column(df, name):
    return [r[name] for r in df.orderBy("g", "k").collect()]


@pytest.mark.parametrize("weights, limit, want", [([1, 2, 3, 2, 5, 1, 10], 5, [0, 0, 1, 1, 2, 3, 4]), ([1] * 8, 3, [0, 0, 0, 1, 1, 1, 2, 2]), ([], 3, []), ([9, 1, 1], 3, [0, 1, 1]), ([1, 9, 1], 3, [0, 1, 2])])
def test_batch_up(spark, weights, limit, want):
    df = numbered(spark, [(w,) for w in weights], "w long")
    assert column(folds.batch_up(df, ["g"], ["k"], "w", limit), "batch_no") == want


@pytest.mark.parametrize("at, limit, delay, want", [([0, 0] + [300_000] * 4, 3, 1000, [0, 0, 1, 1, 1, 2]), ([0, 0, 5000, 5000], 3, 10_000, [0, 0, 0, 1]), ([0, 1000], 3, 1000, [0, 1]), ([0, 999], 3, 1000, [0, 0])])
def test_batch_up_with_timeout(spark, at, limit, delay, want):
    df = numbered(spark, [(1, t) for t in at], "w long, t long")
    assert column(folds.batch_up_with_timeout(df, ["g"], ["k"], "w", "t", limit, delay), "batch_no") == want


def test_group_limits(spark):
    df = numbered(spark, [(w,) for w in (3, 3, 4, 1, 99, 1, 1, 1, 1)], "w long")
    assert column(folds.group_by_limits(df, ["g"], ["k"], "w", 3, 10), "batch_no") == [0, 0, 0, 1, 2, 3, 3, 3, 4]


def test_soft_byte_split(spark):
    df = numbered(spark, [(300,)] * 20, "w long")
    got = column(folds.split_by_bytes(df, ["g"], ["k"], "w", 2000), "batch_no")
    assert [got.count(b) for b in range(3)] == [7, 7, 6]


def test_timed_windows_grow(spark):
    # every 11 seconds two events; windows of a minute that begin with a quarter
    df = numbered(spark, [(11_000 * (k // 2 + 1), 0) for k in range(30)], "t long, s long")
    got = folds.timed_windows(df, ["g"], ["k"], "t", 60_000, 0.25, start_ms="s")
    starts = sorted({(r.window_no, r.window_start_ms) for r in got.collect()})
    assert starts == [(0, 0), (1, 22_000), (2, 55_000), (3, 121_000)]


def test_boundaries_restart_windows(spark):
    df = numbered(spark, [(t, b) for t, b in ((0, "x"), (10, "x"), (20, "y"), (200, "y"))], "t long, b string")
    assert column(folds.timed_windows(df, ["g"], ["k"], "t", 100, 0.5, boundary="b"), "window_no") == [0, 0, 1, 2]


def test_debounce(spark):
    # every 20 seconds eight acknowledgements, merged for 30 seconds from the first
    df = numbered(spark, [(20_000 * (k // 8 + 1),) for k in range(40)], "t long")
    got = column(folds.debounce(df, ["g"], ["k"], "t", 30_000), "commit_no")
    assert [got.count(c) for c in range(3)] == [16, 16, 8]
    assert column(folds.debounce(df, ["g"], ["k"], "t", 0), "commit_no") == list(range(40))


def test_repeat_periodically(spark):
    df = spark.createDataFrame([(0, 0, "a"), (0, 25, "b")], "g int, t long, v string")
    got = [(r.v, r.emitted_ms) for r in folds.repeat_periodically(df, ["g"], "t", 10, 50).orderBy("emitted_ms").collect()]
    assert got == [("a", 0), ("a", 10), ("a", 20), ("b", 25), ("b", 35), ("b", 45)]


def test_folds_keep_groups_apart(spark):
    r = random.Random(1)
    rows = [(g, k, r.randint(1, 9)) for g in (None, 1, 2, 3) for k in range(50)]
    got = folds.batch_up(spark.createDataFrame(r.sample(rows, len(rows)), "g int, k int, w long"), ["g"], ["k"], "w", 12).collect()
    for g in (None, 1, 2, 3):
        own = sorted((x.k, x.w, x.batch_no) for x in got if x.g == g)
        pending, batch, want = None, -1, []
        for _, w, _ in own:
            if pending is None or pending + w > 12:
                batch, pending = batch + 1, w
            else:
                pending += w
            if pending == 12:
                pending = None
            want.append(batch)
        assert [b for *_, b in own] == want


def test_chunks(spark):
    got = column(folds.chunk_numbers(numbered(spark, [(1,)] * 2001, "x int"), ["g"], ["k"]), "chunk_no")
    assert [got.count(c) for c in range(3)] == [1000, 1000, 1]


def test_random_first_window(spark):
    assert folds.random_scaling(lambda: 0.0) == 0.25 and folds.random_scaling(lambda: 0.5) == 0.375 and 0.25 <= folds.random_scaling() < 0.5
    df = spark.createDataFrame([(1, 10 * k) for k in range(100)], "g int, t long")
    got = [r.window_no for r in folds.timed_windows(df, ["g"], ["t"], "t", 1000, None).orderBy("t").collect()]
    first = got.count(0)
    assert 25 <= first <= 50 and got.count(1) >= min(2 * first - 1, 100 - first)
