"""The pipeline's stages against brute force, each on the rows its predecessor kept."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from test_dedup import repeats
from test_jaccard import near_groups
from test_others import stats

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The stages' inputs and outputs, each written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]


def test_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == list(corpus_pipeline.COLUMNS) and after.schema["n_chars"].dataType == before.schema["n_chars"].dataType, name


def test_quality_stage(spark, stages):
    before, after = (rows(x) for x in stages["quality_rules"])
    kept = {r[0] for r in after}
    assert set(after) <= set(before)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in before:
        s = stats(r[1])
        failed = s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]
        assert not (failed and r[0] in kept)
        if labels.get(r[0]) == 1 and not failed:
            assert r[0] in kept
    bad = [r for r in before if labels.get(r[0]) == 0]
    # eleven labels teach little; how well rules are learned is tested on more rows
    assert sum(r[0] in kept for r in bad) < len(bad)


def test_near_dedup_stage(stages):
    """A stage on word shingles takes five words and similarity 0.8, other than op10's contract."""
    before, after = (sorted(rows(x)) for x in stages["simhash_near_dedup"])
    assert after == [r for k, (r, g) in enumerate(zip(before, near_groups([r[1] for r in before]))) if g == k]


def test_substring_stage(stages):
    before, after = (sorted(rows(x)) for x in stages["substring_dedup"])
    want = repeats(before, 20)
    assert [r[0] for r in after] == [r[0] for r in before] and any(v[1] for v in want.values())
    for a, b in zip(after, before):
        n, gone, _ = want[a[0]]
        assert len(a[1].encode().split()) == n - gone and a[4] == len(a[1]) and a[2:4] == b[2:4]
        if not gone:
            assert a[1] == b[1]


def test_decontamination_stage(spark, stages):
    import re

    before, after = (sorted(rows(x)) for x in stages["benchmark_decontamination"])
    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {r[0] for r in before if any(i in flat(r[1]) for i in items)}
    seeds = {tuple(i.split()[k : k + 5]) for i in items for k in range(len(i.split()) - 4)}
    touched = {r[0] for r in before if any(tuple(flat(r[1]).split()[k : k + 5]) in seeds for k in range(len(flat(r[1]).split()) - 4))}
    dropped = {r[0] for r in before} - {r[0] for r in after}
    assert set(after) <= set(before) and whole <= dropped <= touched and dropped


def test_packing_stage(stages):
    before, after = stages["best_fit_packing"]
    got = after.collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows(before)}
    assert max(Counter((r.doc_id, r.piece) for r in got).values()) == 1
    fill = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("at"))
    assert fill.filter("n > 4096 OR n <> end OR at <> 0").count() == 0
    total = sum(r.length for r in got)
    assert fill.count() == -(-total // 4096)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, docs, no_docs, empty, tmp_path):
    """Nulls, empty and long texts, rows that repeat, columns of clashing names; and no rows at all."""
    own, seen = no_docs if empty else docs, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, own, SF).write.parquet(str(tmp_path / name))
        own = spark.read.parquet(str(tmp_path / name))
        seen.append(own.count())
        assert name == "best_fit_packing" or own.columns == list(corpus_pipeline.COLUMNS)
    assert seen == [0] * 5 if empty else seen[0] >= seen[1] >= seen[2] >= seen[3] > 0


def test_run_equals_the_stages(spark, stages):
    got = {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {(r.doc_id, r.piece, r.ids_crc32) for r in stages["best_fit_packing"][1].collect()}


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert os.path.exists(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", ["op3_warc_archive", "op9_substring_dedup", "quality_statistics"])
def test_query_equals_its_sql(spark, name):
    import duckdb
    from millrace.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    answer = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert Counter(map(tuple, QUERIES[name](spark, SF).select(*names).collect())) == Counter(answer.fetchall())


def test_two_pipelines_at_once_keep_their_tables_apart(spark, tmp_path):
    """Threads share a session but not the lists of tables to remove; what is left is each one's result."""
    import threading

    from millrace.llm import common

    before = set(os.listdir(common.shared_dir(spark)))
    want = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=str)
    found, errors = {}, []

    def one(k):
        try:
            found[k] = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=one, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(600)
    assert not errors and all(Counter(map(tuple, found[k])) == Counter((r[0], r[1], r[3], r[4]) for r in want) for k in range(2))
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(common.shared_dir(spark))) - before}
    assert left == {"best_fit_packing"}


def test_run_reads_documents_a_few_times(spark, tmp_path):
    """Stages read what their predecessor wrote; the table itself is read by the first one alone."""
    source = tmp_path / "sf"
    source.mkdir()
    for name in ("documents", "labels", "benchmark"):
        os.symlink(f"{SF}/{name}.parquet", source / f"{name}.parquet")
    listener_bus = spark.sparkContext._jsc.sc().listenerBus()
    store = spark._jsparkSession.sharedState().statusStore()
    first = store.executionsCount()
    corpus_pipeline.run(spark, str(source))
    listener_bus.waitUntilEmpty(10_000)
    plans = [store.executionsList().apply(int(k)).physicalPlanDescription() for k in range(first, store.executionsCount())]
    assert len(plans) > 20 and sum(f"{source}/documents.parquet" in p for p in plans) <= 3
