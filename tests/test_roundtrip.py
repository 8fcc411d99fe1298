"""The round trip of all texts: long, null and of odd, negative and null ids."""

import random

from millrace.plans import catalogue


def test_compress_roundtrip_keeps_every_document(spark, tmp_path):
    import duckdb

    r = random.Random(1)
    rows = [(0, "".join(chr(r.randint(33, 126)) for _ in range(600_000)), "a"), (1, "x" * 1_500_000, "a"), (2, "y" * 1_500_000, "b"), (-3, "minus", "a"), (None, "no id", "b"), (5, None, "a"), (7, "", "b"), (8, None, "c"), (9, "one", None)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = {tuple(x) for x in c.execute(catalogue.ORACLE_SQL["compress_roundtrip"]).fetchall()}
    assert {(x.source, x.n, x.n_bytes, x.digest) for x in catalogue.compress_roundtrip(spark, str(tmp_path)).collect()} == want
