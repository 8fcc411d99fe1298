import random

import numpy as np
import pytest
from millrace.operators import cuts, folds
from millrace.operators.cuts import Pending, Rule, Stretch, follow


def cells(rule, rows):
    """(number, opened) of each row, one row after another; rows are (group, boundary, weight, time, start)."""
    out, group, boundary = [], object(), None
    for g, b, w, t, s in rows:
        first = group != g
        if first or boundary != b:
            number, level, opened, total, n, closed = (0 if first else number + 1), 0, s if first else t, 0, 0, False
            if rule.growing and t >= opened + rule.lengths[0]:
                number, level, opened = number + 1, min(1, rule.levels - 1), t
            group, boundary = g, b
        else:
            ends = closed
            if rule.max_weight is not None:
                ends |= {"before": total + w > rule.max_weight, "after": total > rule.max_weight, "reach": w >= rule.max_weight or total + w > rule.max_weight}[rule.weights]
            ends |= rule.max_records is not None and n + 1 > rule.max_records
            ends |= bool(rule.lengths) and t >= opened + rule.lengths[level]
            if ends:
                number, level, opened, total, n = number + 1, min(level + 1, rule.levels - 1), t, 0, 0
        total, n = total + w, n + 1
        closed = rule.weights == "reach" and rule.max_weight is not None and total >= rule.max_weight
        out.append((number, opened))
    return out


RULES = [
    Rule(7), Rule(7, "after"), Rule(7, "reach"), Rule(0, "reach"), Rule(max_records=3), Rule(20, "before", 4), Rule(1000, "reach", lengths=(5,)), Rule(9, "reach", lengths=(4,)), Rule(lengths=(6,)), Rule(lengths=(0,)),
    Rule(lengths=folds.window_lengths(16, 2), growing=True), Rule(lengths=folds.window_lengths(10, 3), growing=True), Rule(lengths=folds.window_lengths(10, 10), growing=True), Rule(lengths=folds.window_lengths(3, 0), growing=True), Rule(lengths=(10**9,)),
]


def random_rows(r, n):
    rows, group, boundary, time, start = [], 0, 0, 0, 0
    for _ in range(n):
        if r.random() < r.choice([0.0, 0.02]):
            group, boundary, time = group + 1, 0, r.randint(-5, 5)
            start = time - r.choice([0, 0, 3, 30])
        if r.random() < 0.02:
            boundary += 1
        rows.append((group, boundary, r.choice([0, 0, 1, 2, 3, 7, 9]), time, start))
        time += r.choice([0, 0, 1, 2, 5])
    return rows


def stretch_of(rule, rows):
    return Stretch(rule, *(np.array(x, dtype=np.int64) for x in zip(*rows)))


@pytest.mark.parametrize("rule", RULES, ids=str)
def test_ranges_and_maps_equal_going_through_all_rows(rule):
    r = random.Random(str(rule))
    for _ in range(60):
        rows = random_rows(r, r.choice([1, 2, 30, 200]))
        want = cells(rule, rows)
        bounds = sorted({0, len(rows), *(r.randrange(len(rows) + 1) for _ in range(r.choice([0, 1, 5, 40])))})
        got, pending, before = [], None, (None, None)
        for low, high in zip(bounds, bounds[1:]):
            own = stretch_of(rule, rows[low:high])
            if rows[low][0] != before[0]:
                pending = None
            forced = rows[low][1] != before[1]
            numbers, opened, left = own.number(pending, forced)
            got += zip(numbers.tolist(), opened.tolist())
            # the map says the same without going through the rows again
            assert follow(rule, own.map_(), pending, forced) == left, (rows[low:high], pending)
            pending, before = left, rows[high - 1][:2]
        assert got == want


def test_a_map_holds_a_cell_and_no_more():
    rows = [(0, 0, 1, k, 0) for k in range(50_000)]
    for rule, most in ((Rule(100), 101), (Rule(100, "reach"), 101), (Rule(max_records=7), 8), (Rule(lengths=folds.window_lengths(64, 16), growing=True), 65)):
        found = stretch_of(rule, rows).map_()
        assert len(found["weights"]) <= most and len(found["exits"][0]) <= most * rule.levels
    # a range with the end of a group in it is a single state
    assert stretch_of(Rule(100), [*rows, (1, 0, 1, 0, 0)]).map_()["exits"] == []
    assert follow(Rule(100), stretch_of(Rule(100), [*rows, (1, 0, 5, 0, 0)]).map_(), Pending(3, 3, 0, 0, 9), False) == Pending(5, 1, 0, 0, 0)


@pytest.fixture
def many_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("groups", [1, 4])
def test_a_group_over_many_tasks(spark, many_ranges, groups):
    """Each operator over groups that many ranges share, against going through the rows one by one."""
    r = random.Random(groups)
    rows, time = [], 0
    for k in range(3000):
        rows.append((None if k % groups == 3 else k % groups, k, r.choice([0, 1, 2, 5, 30]), time))
        time += r.choice([0, 0, 3, 40])
    df = spark.createDataFrame(r.sample(rows, len(rows)), "g int, k int, w long, t long").selectExpr("*", "'clash' AS _g", "'clash' AS c0", "CASE WHEN w = 0 THEN NULL ELSE w END AS v", "0L AS s", "t DIV 5000 AS b")
    cases = [
        (folds.batch_up(df, ["g"], ["k"], "v", 30), Rule(30, "reach"), "batch_no"), (folds.group_by_limits(df, ["g"], ["k"], "v", 6, 50), Rule(50, "before", 6), "batch_no"),
        (folds.split_by_bytes(df, ["g"], ["k"], "v", 60), Rule(60, "after"), "batch_no"), (folds.batch_up_with_timeout(df, ["g"], ["k"], "v", "t", 30, 25), Rule(30, "reach", lengths=(25,)), "batch_no"),
        (folds.debounce(df, ["g"], ["k"], "t", 90), Rule(lengths=(90,)), "commit_no"), (folds.timed_windows(df, ["g"], ["k"], "t", 400, 0.25), Rule(lengths=(100, 200, 400), growing=True), "window_no"),
        (folds.timed_windows(df, ["g"], ["k"], "t", 400, 0.25, "s", "b"), Rule(lengths=(100, 200, 400), growing=True), "window_no"),
        (folds.debounce(df, ["g"], ["k"], "t", 10**8), Rule(lengths=(10**8,)), "commit_no"),
    ]
    for n, (got, rule, name) in enumerate(cases):
        own = got.collect()
        assert len({x["part"] for x in got.selectExpr("spark_partition_id() AS part").distinct().collect()}) == 7
        timed, started = bool(rule.lengths), n == 6
        by_group = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[3] if timed else 0, x[1]))
        plain = [(g, t // 5000 if started else 0, w, t, 0 if started else t) for g, _, w, t in by_group]
        if not started:  # a group begins with its first row
            firsts = {}
            plain = [(g, b, w, t, firsts.setdefault(g, t)) for g, b, w, t, _ in plain]
        want = {(g, k): c for (g, k, *_), c in zip(by_group, cells(rule, plain))}
        assert {(x.g, x.k): (x[name], x["window_start_ms"] if name == "window_no" else want[x.g, x.k][1]) for x in own} == want
        assert own[0]._g == own[0].c0 == "clash"
    assert folds.batch_up(df.limit(0), ["g"], ["k"], "w", 3).collect() == [] and folds.batch_up(df, [], ["g", "k"], "w", 3).count() == 3000


def test_one_stream_of_a_million_rows(spark, many_ranges):
    stream = spark.range(1_000_000).selectExpr("id", "id * 7 AS t", "id % 5 AS w")
    windows = folds.timed_windows(stream, [], ["id"], "t", 7000, 0.25)
    sizes = dict(windows.groupBy("window_no").count().collect())
    assert sizes[0] == 250 and sizes[1] == 500 and all(sizes[k] == 1000 for k in range(2, max(sizes))) and sum(sizes.values()) == 1_000_000
    got = folds.batch_up(stream, [], ["id"], "w", 10).groupBy("batch_no").agg({"w": "sum"}).collect()
    assert len(got) == 200_000 and all(x["sum(w)"] == 10 for x in got)
