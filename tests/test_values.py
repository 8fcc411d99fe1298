import pytest
from millrace.functions.keys import Criterion, key_matches, schema_key, skipped
from millrace.functions.values import codec, entity_column, money, money_ok, snake_case, snake_case_text
from millrace.operators import deadletters, entities, metrics
from pyspark.sql import functions as F


def test_money(spark):
    cases = [(12.34, True), (12.3456, False), (12345678987654321.34, False), (float("nan"), False), (0.1, True), (0.1 + 0.2, False), (-0.01, True), (1e300, False), (None, True)]
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(cases)], "k int, v double")
    for r in df.select("k", money_ok(F.col("v")).alias("ok"), money(F.col("v")).alias("m")).collect():
        value, want = cases[r.k]
        assert r.ok == want and (r.m is None) == (not want or value is None)


@pytest.mark.parametrize("name, want", [("myString", "my_string"), ("1myString", "_1my_string"), ("col_a", "col_a"), ("a.b-c", "a_b_c"), ("HTTPServer", "httpserver"), ("AbC", "ab_c")])
def test_column_names(spark, name, want):
    assert snake_case_text(name) == want
    assert spark.range(1).select(snake_case(F.lit(name))).first()[0] == want
    assert entity_column("contexts", "com.acme.x", "myThing", 2) == "contexts_com_acme_x_my_thing_2"


def test_schema_keys(spark):
    df = spark.createDataFrame([("schema:com.acme/thing/jsonschema/1-2-3",), ("nonsense",), (None,)], "s string")
    got = [r[0] for r in df.select(schema_key(F.col("s"))).collect()]
    assert tuple(got[0]) == ("com.acme", "thing", "jsonschema", 1, 2, 3) and got[1:] == [None, None]
    match = df.select(key_matches(schema_key(F.col("s")), "com.acme", "thing", 1, [(2, 3)]), key_matches(schema_key(F.col("s")), "com.acme", "thing", 1, [(2, 4)])).collect()
    assert [tuple(r) for r in match] == [(True, False), (False, False), (False, False)]


@pytest.mark.parametrize("text, want", [("1-2-3", True), ("1-2-*", True), ("1-*-*", True), ("*-*-*", True), ("1-2-4", False), ("2-*-*", False)])
def test_criteria(spark, text, want):
    c = Criterion.parse(f"schema:com.acme/thing/jsonschema/{text}")
    assert spark.range(1).select(skipped(schema_key(F.lit("schema:com.acme/thing/jsonschema/1-2-3")), [c])).first()[0] == want


def test_broken_criteria():
    for text in ("schema:a/b/c/1-*-1", "schema:a/b/c/*-1-*", "a/b/c/1-1-1", "schema:a/b/1-1-1"):
        with pytest.raises(ValueError):
            Criterion.parse(text)


def test_codec_by_signature(spark):
    cases = {b"\x28\xb5\x2f\xfdxx": "zstd", b"\x1f\x8b": "gzip", b"\x28\xb5\x2f": "plain", b"": "plain", None: "plain", b"\x1f": "plain"}
    df = spark.createDataFrame([(k, v) for k, v in enumerate(cases)], "k int, v binary")
    want = list(cases.values())
    assert all(r.c == want[r.k] for r in df.select("k", codec(F.col("v")).alias("c")).collect())


def test_bad_row_sizes(spark):
    row = ("é" * 700).encode()
    df = spark.createDataFrame([(0, bytearray(row)), (1, bytearray(b"x" * 999)), (2, bytearray(b"x" * 1000)), (3, None)], "k int, v binary")
    got = {r.k: r.o for r in df.select("k", deadletters.with_max_size(F.col("v"), "p", 1000).alias("o")).collect()}
    import json

    assert json.loads(bytes(got[0]))["payload"] == "é" * 50 and json.loads(bytes(got[0]))["actual"] == 1400
    assert bytes(got[1]) == b"x" * 999 and got[3] is None
    assert json.loads(bytes(got[2]))["payload"] == "x" * 100
    cut = spark.range(1).select(*[deadletters.utf8_prefix(F.lit("aé日😀".encode()), n) for n in range(11)]).first()
    assert [bytes(c).decode() for c in cut] == ["", "a", "a", "aé", "aé", "aé", "aé日", "aé日", "aé日", "aé日", "aé日😀"]


def test_families_and_routing(spark):
    e = lambda n, v: (f"schema:com.acme/{n}/jsonschema/{v}", "{}")
    kind = "struct<schema:string,data:string>"
    df = spark.createDataFrame([(e("a", "1-0-0"), [e("b", "1-0-1"), e("b", "1-1-0")], None), (None, [], [e("a", "1-0-2"), e("a", "2-0-0")]), (("junk", "{}"), None, None)], f"unstruct_event {kind}, contexts array<{kind}>, derived_contexts array<{kind}>")
    found = entities.families(entities.entity_uris(df, ["unstruct_event", "contexts", "derived_contexts"]))
    got = {(r.name, r.model): [tuple(v) for v in r.versions] for r in found.collect()}
    assert got == {("a", 1): [(0, 0), (0, 2)], ("a", 2): [(0, 0)], ("b", 1): [(0, 1), (1, 0)]}
    good, bad = entities.route(spark.range(4), F.when(F.col("id") > 1, F.array(F.lit("big"))))
    assert good.count() == 2 and bad.count() == 2


def test_metrics_and_health(spark):
    df = spark.createDataFrame([(1, -3.0), (1, -1.0), (3, 5.0)], "p int, v double")
    periods = spark.range(1, 5).select(F.col("id").cast("int").alias("period"))
    assert sorted(map(tuple, metrics.counters(df, F.col("p"), periods, F.lit(1)).collect())) == [(1, 2), (2, 0), (3, 1), (4, 0)]
    assert sorted(map(tuple, metrics.gauges(df, F.col("p"), F.col("v").cast("int")).collect())) == [(1, 0), (3, 5)]
    assert metrics.latency_ms(spark.createDataFrame([], "ts timestamp"), "ts", F.current_timestamp()).first()[0] == 0
    states = [(10, 0, True, True, "healthy"), (11, 0, True, True, "lagging"), (0, 11, False, True, "inactive"), (0, 10, False, True, "healthy"), (99, 99, True, False, "disconnected")]
    rows = spark.createDataFrame(states, "latency int, idle int, busy boolean, connected boolean, want string")
    assert all(r.status == r.want for r in metrics.health(rows, "latency", "idle", "busy", "connected", 10).collect())
