"""Every operator applied to the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import Criterion, schema_key, version
from ..functions.values import codec, money, money_ok, snake_case
from ..operators import codec as codecs
from ..operators import deadletters, entities, folds, metrics
from .atomic import atomic_fields
from .schemas import Family, Registry, Resolved, resolve, resolve_family
from .strict import strict
from .transform import transform_events, with_schema_version

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Events as self-describing envelopes: schema, data."""
    uri = F.concat(F.lit("schema:com.acme/"), F.col("event_type"), F.lit("/jsonschema/1-0-"), (F.col("user_id") % 3).cast("string"))
    return _table(spark, d, "events").withColumn("schema", uri).withColumn("data", F.col("props"))


_ENV = "env AS (SELECT *, 'schema:com.acme/' || event_type || '/jsonschema/1-0-' || (user_id % 3)::VARCHAR AS schema, user_id % 3 AS addition FROM events)"
_MONEY = lambda x: f"coalesce(TRY_CAST({x} AS DECIMAL(18,2))::DOUBLE = {x}, false)"


# the flagship: envelope, family, strict money, strict leaf, routing and totals in one plan
@query(f"""
WITH {_ENV}, j AS (SELECT *, json_type(props, '$.k') AS kind FROM env),
o AS (SELECT event_type AS name, addition::INT AS addition, value, {_MONEY('value')} AND coalesce(kind IN ('BIGINT','UBIGINT'), false) AS good FROM j)
SELECT name, addition, good, count(*) AS n, round(sum(value), 2) AS total FROM o GROUP BY ALL
""")
def load_events(spark: SparkSession, d: str) -> DataFrame:
    df = _envelopes(spark, d).withColumn("k", schema_key(F.col("schema")))
    _, errors = strict("try_variant_get(try_parse_json(data), '$.k', 'variant')", "long", False, "k")
    bad_money = F.when(money_ok(F.col("value")), F.lit(0)).otherwise(F.lit(1))
    good = (F.size(errors) + bad_money) == 0
    return df.groupBy(F.col("k.name").alias("name"), F.col("k.addition").alias("addition"), good.alias("good")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, {_MONEY('v')} AS ok, CASE WHEN {_MONEY('v')} THEN TRY_CAST(v AS DECIMAL(18,2)) END::VARCHAR AS amount FROM x
""")
def money_strict(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", money_ok(v).alias("ok"), money(v).cast("string").alias("amount"))


@query(f"""
WITH x AS (SELECT l_returnflag, l_extendedprice * (1 - l_discount) AS v FROM lineitem)
SELECT l_returnflag, count(*) FILTER (WHERE NOT {_MONEY('v')}) AS rejected, count(*) AS n FROM x GROUP BY ALL
""")
def money_reject(spark: SparkSession, d: str) -> DataFrame:
    bad = (~money_ok(F.col("l_extendedprice") * (1 - F.col("l_discount")))).cast("long")
    return _table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(bad).alias("rejected"), F.count("*").alias("n"))


@query("""
SELECT event_type, count(*) FILTER (WHERE value >= 10 AND json_extract(props, '$.k')::INT % 2 = 0) AS good,
  count(*) FILTER (WHERE NOT (value >= 10 AND json_extract(props, '$.k')::INT % 2 = 0)) AS bad FROM events GROUP BY ALL
""")
def route_good_bad_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    errors = F.filter(F.array(F.when(F.col("value") < 10, "value"), F.when(k % 2 != 0, "k")), lambda e: e.isNotNull())
    good, bad = entities.route(_table(spark, d, "events"), errors)
    both = good.select("event_type", F.lit(1).alias("g")).unionByName(bad.select("event_type", F.lit(0).alias("g")))
    return both.groupBy("event_type").agg(F.sum("g").alias("good"), F.sum(1 - F.col("g")).alias("bad"))


@query(f"""
WITH {_ENV} SELECT 'com.acme' AS vendor, event_type AS name, 1 AS model,
  string_agg(DISTINCT '0-' || addition::VARCHAR, ',' ORDER BY '0-' || addition::VARCHAR) AS versions, '0-' || max(addition)::VARCHAR AS latest FROM env GROUP BY event_type
""")
def family_versions(spark: SparkSession, d: str) -> DataFrame:
    f = entities.families(_envelopes(spark, d))
    text = lambda v: F.concat_ws("-", v["revision"].cast("string"), v["addition"].cast("string"))
    return f.select("vendor", "name", "model", F.array_join(F.transform("versions", text), ",").alias("versions"), text(F.col("latest")).alias("latest"))


@query(f"WITH {_ENV} SELECT user_id, max(addition)::INT AS addition FROM env GROUP BY user_id")
def version_max(spark: SparkSession, d: str) -> DataFrame:
    v = version(schema_key(F.col("schema")))
    return _envelopes(spark, d).groupBy("user_id").agg(F.max(v).alias("v")).select("user_id", F.col("v.addition").alias("addition"))


_REGISTRY = [("com.acme", t, 1, 0, a) for t in ("click", "view", "purchase", "login") for a in range(3)]
_PROPERTY = lambda kind: {"type": "object", "properties": {"k": {"type": kind}}, "required": ["k"]}
_VALUES = lambda rows: ", ".join(f"('{v}', '{n}', {m}, {r}, {a})" for v, n, m, r, a in rows)
_FIVE = "vendor string, name string, model int, revision int, addition int"


@query(f"""
WITH {_ENV}, registry(vendor, name, model, revision, addition) AS (VALUES {_VALUES(_REGISTRY)}),
wanted AS (SELECT event_type AS name, max(addition) AS a FROM env GROUP BY event_type)
SELECT x.vendor, x.name, x.model::INT AS model, revision::INT AS revision, addition::INT AS addition, '1-0-' || a AS requested
FROM registry x JOIN wanted w ON x.name = w.name AND (revision = 0 AND addition <= a)
""")
def registry_upto(spark: SparkSession, d: str) -> DataFrame:
    """Versions that the registry has up to the latest one that the events hold of a family."""
    wanted = entities.families(_envelopes(spark, d)).select("vendor", "name", "model", "latest.revision", "latest.addition")
    return entities.versions_up_to(spark.createDataFrame(_REGISTRY, _FIVE), wanted)


@query(f"""
WITH {_ENV}, registry(vendor, name, model, revision, addition) AS (VALUES {_VALUES([x for x in _REGISTRY if x[4] < 2])})
SELECT event_type, count(*) AS n FROM env WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE r.name = event_type AND r.addition = env.addition) GROUP BY ALL
""")
def missing_schema_fail(spark: SparkSession, d: str) -> DataFrame:
    """Events that fail as the registry lacks their schema, by way of the failures that the transformation gives them."""
    df = _envelopes(spark, d)
    registry = Registry({x: _PROPERTY("integer") for x in _REGISTRY if x[4] < 2})
    # each version for itself: as many rows as a batch has versions
    found = [(Family("unstruct_event", f.vendor, f.name, f.model), (v.revision, v.addition)) for f in entities.families(df).collect() for v in f.versions]
    failures = [failure for family, v in found if (failure := resolve_family(family, [v], registry)[1])]
    events = df.select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("event"), F.struct("schema", "data").alias("unstruct_event"))
    failed = transform_events(events, Resolved((), tuple(failures))).filter(F.size("errors") > 0)
    return failed.groupBy(F.col("event").alias("event_type")).agg(F.count("*").alias("n"))


def _skip(criteria: list[str]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        kept = entities.skip_entities(_envelopes(spark, d), [Criterion.parse(f"schema:com.acme/{c}") for c in criteria])
        return kept.groupBy("event_type", (F.col("user_id") % 3).cast("int").alias("addition")).agg(F.count("*").alias("n"))

    return run


for _name, _criteria, _where in (
    ("none", [], "true"),
    ("exact", ["click/jsonschema/1-0-1"], "NOT (event_type = 'click' AND addition = 1)"),
    ("additions", ["click/jsonschema/1-0-*"], "event_type <> 'click'"),
    ("model", ["view/jsonschema/1-*-*"], "event_type <> 'view'"),
    ("all", ["click/jsonschema/*-*-*", "view/jsonschema/*-*-*"], "event_type NOT IN ('click', 'view')"),
    ("mixed", ["click/jsonschema/1-0-2", "purchase/jsonschema/*-*-*", "other/jsonschema/1-0-0"], "NOT (event_type = 'click' AND addition = 2) AND event_type <> 'purchase'"),
):
    QUERIES[f"skip_criteria_{_name}"] = _skip(_criteria)
    ORACLE_SQL[f"skip_criteria_{_name}"] = f"WITH {_ENV} SELECT event_type, addition::INT AS addition, count(*) AS n FROM env WHERE {_where} GROUP BY ALL"

_SNAKE = lambda x: f"regexp_replace(regexp_replace(lower(regexp_replace({x}, '([^A-Z_])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9_]', '_', 'g'), '^([0-9])', '_\\1')"


@query(f"""
WITH x AS (SELECT DISTINCT p_name AS member, left({_SNAKE('p_name')}, 6) AS column_name FROM part)
SELECT column_name, count(*) AS n, string_agg(member, ',' ORDER BY member) AS members FROM x GROUP BY column_name HAVING count(*) > 1
""")
def clash_names(spark: SparkSession, d: str) -> DataFrame:
    found = entities.clashes(_table(spark, d, "part"), "p_name", F.substring(snake_case(F.col("p_name")), 1, 6))
    return found.withColumn("members", F.array_join("members", ","))


@query(f"""
SELECT p_partkey, {_SNAKE('p_name')} AS name, {_SNAKE('p_brand')} AS brand, {_SNAKE("p_partkey::VARCHAR || 'MyCol.' || p_type")} AS made FROM part
""")
def column_name_sanitise(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.col("p_partkey").cast("string"), F.lit("MyCol."), F.col("p_type"))
    return _table(spark, d, "part").select("p_partkey", snake_case(F.col("p_name")).alias("name"), snake_case(F.col("p_brand")).alias("brand"), snake_case(made).alias("made"))


@query("""
WITH x AS (SELECT event_id, json_type(props, '$.k') AS kind, json_extract_string(props, '$.k') AS v FROM events)
SELECT event_id, CASE WHEN kind IN ('BIGINT','UBIGINT') THEN v::BIGINT END AS as_long, coalesce(kind NOT IN ('BIGINT','UBIGINT'), true) AS long_fails, coalesce(kind <> 'VARCHAR', true) AS string_fails FROM x
""")
def json_leaf_type(spark: SparkSession, d: str) -> DataFrame:
    v = "try_variant_get(try_parse_json(props), '$.k', 'variant')"
    as_long, long_errors = strict(v, "long", False, "k")
    _, string_errors = strict(v, "string", False, "k")
    return _table(spark, d, "events").select("event_id", as_long.alias("as_long"), (F.size(long_errors) > 0).alias("long_fails"), (F.size(string_errors) > 0).alias("string_fails"))


def _registry() -> Registry:
    kinds = {"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"]}
    return Registry({("com.acme", "click", 1, 0, a): kinds for a in range(2)})


@query(f"""
WITH {_ENV}, o AS (SELECT event_id, (event_type = 'click' AND addition < 2) AS own, json_extract(props, '$.k')::BIGINT AS k FROM env)
SELECT event_id, CASE WHEN own THEN k END AS k, CASE WHEN own THEN 1 END AS n_contexts, CASE WHEN own THEN k END AS context_k FROM o
""")
def entity_column_null_when_absent(spark: SparkSession, d: str) -> DataFrame:
    families = {Family(kind, "com.acme", "click", 1): [(0, 0), (0, 1)] for kind in ("unstruct_event", "contexts")}
    entity = F.struct("schema", "data")
    # the id keeps its place among the atomic columns
    df = _envelopes(spark, d).select(F.col("event_id").cast("string").alias("event_id"), entity.alias("unstruct_event"), F.array(entity).alias("contexts"))
    out = transform_events(df, resolve(families, _registry()))
    contexts = F.col("contexts_com_acme_click_1")
    return out.select(F.col("event_id").cast("long").alias("event_id"), F.col("unstruct_event_com_acme_click_1.k").alias("k"), F.size(contexts).alias("_n"), contexts).select("event_id", "k", F.when(contexts.isNotNull(), F.col("_n")).alias("n_contexts"), F.get(contexts, 0)["k"].alias("context_k"))



@query(f"""
WITH {_ENV}, j AS (SELECT *, json_type(props, '$.k') IN ('BIGINT','UBIGINT') AS whole, json_type(props, '$.k') IN ('BIGINT','UBIGINT','DOUBLE') AS number, json_extract_string(props, '$.k') AS k FROM env),
o AS (SELECT *, event_type = 'click' AND addition <> 1 AS c, event_type = 'click' AND addition = 1 AS r, event_type = 'view' AND addition < 2 AS v FROM j)
SELECT event_id, CASE WHEN {_MONEY('value')} THEN TRY_CAST(value AS DECIMAL(18,2)) END::VARCHAR AS total,
  CASE WHEN c AND whole THEN k::BIGINT END AS click_k, CASE WHEN r AND number THEN k::DOUBLE END AS recovered_k, CASE WHEN v AND whole THEN k::BIGINT END AS view_k,
  CASE WHEN event_type = 'click' AND user_id % 5 <> 0 AND whole THEN k::BIGINT END AS context_k,
  CASE WHEN event_type NOT IN ('click', 'view') THEN 1
    ELSE (NOT {_MONEY('value')})::INT + ((c OR v) AND NOT coalesce(whole, false))::INT + (r AND NOT coalesce(number, false))::INT
      + (event_type = 'click' AND (user_id % 5 = 0 OR NOT coalesce(whole, false)))::INT END AS n_errors,
  CASE WHEN event_type NOT IN ('click', 'view') THEN 'no schema com.acme/' || event_type || '/1-0-' || (SELECT max(e.addition) FROM env e WHERE e.event_type = o.event_type)::VARCHAR END AS failure
FROM o
""")
def transform_batch(spark: SparkSession, d: str) -> DataFrame:
    """Events through the whole transformation, their families taken from the batch itself.

    Clicks have a version that does not merge and so a recovery column, and a context that is at times of a wrong type;
    views have a version without a schema that is skipped; other types have no schema and fail.
    """
    registry = Registry({("com.acme", "click", 1, 0, a): _PROPERTY("number" if a == 1 else "integer") for a in range(3)} | {("com.acme", "view", 1, 0, a): _PROPERTY("integer") for a in range(2)})
    skip = [Criterion.parse("schema:com.acme/view/jsonschema/1-0-2")]
    context = F.when(F.col("event_type") == "click", F.array(F.struct(F.lit("schema:com.acme/click/jsonschema/1-0-0").alias("schema"), F.when(F.col("user_id") % 5 == 0, F.lit('{"k":"x"}')).otherwise(F.col("data")).alias("data"))))
    df = _envelopes(spark, d).select(F.col("event_id").cast("string").alias("event_id"), F.col("value").alias("tr_total"), F.struct("schema", "data").alias("unstruct_event"), context.alias("contexts"))
    # as many rows as a batch has families
    found = entities.families(entities.entity_uris(df, ["unstruct_event", "contexts"]), by=["kind"]).collect()
    held = {Family(f.kind, f.vendor, f.name, f.model): [(v.revision, v.addition) for v in f.versions] for f in found}
    out = transform_events(df, resolve(held, registry, skip), skip)
    recovered = [c for c in out.columns if "_recovered_1_0_1_" in c and c.startswith("unstruct_event")]
    own = lambda c: F.col(c)["k"] if c in out.columns else F.lit(None)
    context_k = F.get("contexts_com_acme_click_1", 0)["k"] if "contexts_com_acme_click_1" in out.columns else F.lit(None)
    failure = F.get(F.filter(F.transform("errors", lambda e: e["message"]), lambda m: m.startswith("no schema")), 0)
    return out.select(
        F.col("event_id").cast("long").alias("event_id"), F.col("tr_total").cast("string").alias("total"),
        own("unstruct_event_com_acme_click_1").cast("long").alias("click_k"), (own(recovered[0]) if recovered else F.lit(None)).cast("double").alias("recovered_k"),
        own("unstruct_event_com_acme_view_1").cast("long").alias("view_k"), context_k.cast("long").alias("context_k"), F.size("errors").alias("n_errors"), failure.alias("failure"),
    )


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') + count(*) FILTER (WHERE event_type = 'view') AS n_concat,
  CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN count(*) FILTER (WHERE event_type = 'view') ELSE count(*) FILTER (WHERE event_type = 'click') END AS n_overwrite
FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id
""")
def contexts_concat_vs_overwrite(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "events").filter("event_type IN ('click', 'view')")
    own = rows.groupBy("user_id").agg(*[F.collect_list(F.when(F.col("event_type") == t, F.struct(F.lit("schema:com.acme/thing/jsonschema/1-0-0").alias("schema"), F.col("props").alias("data")))).alias(c) for t, c in (("click", "contexts"), ("view", "derived_contexts"))])
    from .transform import transform_unstructured

    both = own.select(F.col("user_id").cast("string").alias("user_id"), "contexts", "derived_contexts", F.concat("contexts", "derived_contexts").alias("all"))
    loose = transform_unstructured(both).select("user_id", F.size(F.from_json(F.col("entities")["contexts_com_acme_thing_1"], "array<string>")).cast("long").alias("n_overwrite"))
    return both.select("user_id", F.size("all").cast("long").alias("n_concat")).join(loose, "user_id").select(F.col("user_id").cast("long").alias("user_id"), "n_concat", "n_overwrite")


@query("""
SELECT event_id::VARCHAR AS event_id, event_type AS event, user_id::VARCHAR AS user_id, value AS se_value, NULL::INT AS txn_id, 129::INT AS n_columns FROM events
""")
def atomic_projection(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("user_id"), F.col("value").alias("se_value"))
    out = transform_events(df, resolve({}, Registry({})))
    assert out.columns[:-1] == [f.name for f in atomic_fields()]
    return out.select("event_id", "event", "user_id", "se_value", "txn_id", F.lit(len(out.columns)).alias("n_columns"))


_NUMBERED = "SELECT source, doc_id, n_chars AS w, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents"


@query(f"""
WITH RECURSIVE d AS ({_NUMBERED}), f AS (
  SELECT source, doc_id, k, 0::BIGINT AS batch_no, CASE WHEN w >= 20000 THEN NULL ELSE w END AS pending FROM d WHERE k = 1
  UNION ALL
  SELECT d.source, d.doc_id, d.k,
    CASE WHEN d.w >= 20000 OR f.pending IS NULL OR f.pending + d.w > 20000 THEN batch_no + 1 ELSE batch_no END,
    CASE WHEN d.w >= 20000 THEN NULL WHEN f.pending IS NULL OR f.pending + d.w > 20000 THEN d.w WHEN f.pending + d.w = 20000 THEN NULL ELSE f.pending + d.w END
  FROM f JOIN d ON d.source = f.source AND d.k = f.k + 1)
SELECT source, doc_id, batch_no FROM f
""")
def batch_up_weight(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return folds.batch_up(docs, ["source"], ["doc_id"], "n_chars", 20_000).drop("n_chars")


@query(f"""
WITH RECURSIVE d AS ({_NUMBERED}), f AS (
  SELECT source, doc_id, k, 0::BIGINT AS batch_no, 1 AS n, w AS total FROM d WHERE k = 1
  UNION ALL
  SELECT d.source, d.doc_id, d.k, CASE WHEN n + 1 > 7 OR total + w > 15000 THEN batch_no + 1 ELSE batch_no END,
    CASE WHEN n + 1 > 7 OR total + w > 15000 THEN 1 ELSE n + 1 END, CASE WHEN n + 1 > 7 OR total + w > 15000 THEN w ELSE total + w END
  FROM f JOIN d ON d.source = f.source AND d.k = f.k + 1)
SELECT source, doc_id, batch_no FROM f
""")
def group_limits(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return folds.group_by_limits(docs, ["source"], ["doc_id"], "n_chars", 7, 15_000).drop("n_chars")


@query(f"""
WITH RECURSIVE d AS ({_NUMBERED}), f AS (
  SELECT source, doc_id, k, 0::BIGINT AS batch_no, w AS total FROM d WHERE k = 1
  UNION ALL
  SELECT d.source, d.doc_id, d.k, CASE WHEN total > 10000 THEN batch_no + 1 ELSE batch_no END, CASE WHEN total > 10000 THEN w ELSE total + w END
  FROM f JOIN d ON d.source = f.source AND d.k = f.k + 1)
SELECT source, doc_id, batch_no FROM f
""")
def batch_split_soft(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return folds.split_by_bytes(docs, ["source"], ["doc_id"], "n_chars", 10_000).drop("n_chars")


@query("SELECT count(*) AS n_rows, sum(octet_length(encode(text)))::BIGINT AS n_bytes FROM documents")
def sum_bytes(spark: SparkSession, d: str) -> DataFrame:
    return entities.total_bytes(_table(spark, d, "documents"), "text")


@query("SELECT o_custkey, o_orderkey, floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 5)::BIGINT AS chunk_no FROM orders")
def chunk_numbers(spark: SparkSession, d: str) -> DataFrame:
    return folds.chunk_numbers(_table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 5)


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms")
    return _table(spark, d, "events").select((F.col("user_id") % 50).cast("int").alias("stream"), "event_id", at)


_ARRIVALS = "a AS (SELECT (user_id % 50)::INT AS stream, event_id, (epoch_us(ts) // 1000) AS at_ms, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS k FROM events)"
_HOUR = 3_600_000


@query(f"""
WITH RECURSIVE {_ARRIVALS}, f AS (
  SELECT stream, event_id, k, 0::BIGINT AS window_no, at_ms AS window_start_ms, {24 * _HOUR // 4}::BIGINT AS len FROM a WHERE k = 1
  UNION ALL
  SELECT a.stream, a.event_id, a.k,
    CASE WHEN a.at_ms >= window_start_ms + len THEN window_no + 1 ELSE window_no END,
    CASE WHEN a.at_ms >= window_start_ms + len THEN a.at_ms ELSE window_start_ms END,
    CASE WHEN a.at_ms >= window_start_ms + len THEN least(2 * len, {24 * _HOUR}) ELSE len END
  FROM f JOIN a ON a.stream = f.stream AND a.k = f.k + 1)
SELECT stream, event_id, window_no, window_start_ms FROM f
""")
def timed_windows(spark: SparkSession, d: str) -> DataFrame:
    return folds.timed_windows(_arrivals(spark, d), ["stream"], ["at_ms", "event_id"], "at_ms", 24 * _HOUR, 0.25).drop("at_ms")


@query(f"""
WITH RECURSIVE {_ARRIVALS}, f AS (
  SELECT stream, event_id, k, 0::BIGINT AS commit_no, at_ms AS first FROM a WHERE k = 1
  UNION ALL
  SELECT a.stream, a.event_id, a.k, CASE WHEN at_ms >= first + {6 * _HOUR} THEN commit_no + 1 ELSE commit_no END, CASE WHEN at_ms >= first + {6 * _HOUR} THEN at_ms ELSE first END
  FROM f JOIN a ON a.stream = f.stream AND a.k = f.k + 1)
SELECT stream, event_id, commit_no FROM f
""")
def debounce(spark: SparkSession, d: str) -> DataFrame:
    return folds.debounce(_arrivals(spark, d), ["stream"], ["at_ms", "event_id"], "at_ms", 6 * _HOUR).drop("at_ms")


@query(f"""
WITH RECURSIVE {_ARRIVALS}, f AS (
  SELECT stream, event_id, k, 0::BIGINT AS batch_no, 1 AS n, at_ms AS opened FROM a WHERE k = 1
  UNION ALL
  SELECT a.stream, a.event_id, a.k, CASE WHEN n = 0 OR at_ms >= opened + {8 * _HOUR} THEN batch_no + 1 ELSE batch_no END,
    CASE WHEN n = 0 OR at_ms >= opened + {8 * _HOUR} THEN 1 WHEN n + 1 = 4 THEN 0 ELSE n + 1 END, CASE WHEN n = 0 OR at_ms >= opened + {8 * _HOUR} THEN at_ms ELSE opened END
  FROM f JOIN a ON a.stream = f.stream AND a.k = f.k + 1)
SELECT stream, event_id, batch_no FROM f
""")
def batch_timeout(spark: SparkSession, d: str) -> DataFrame:
    rows = _arrivals(spark, d).withColumn("w", F.lit(1).cast("long"))
    return folds.batch_up_with_timeout(rows, ["stream"], ["at_ms", "event_id"], "w", "at_ms", 4, 8 * _HOUR).drop("at_ms", "w")


@query(f"""
WITH {_ARRIVALS}, x AS (SELECT stream, event_id, at_ms, lead(at_ms) OVER (PARTITION BY stream ORDER BY at_ms, event_id) AS after FROM a),
y AS (SELECT *, greatest(at_ms, coalesce(after, at_ms + 1) - 1) AS until FROM x)
SELECT stream, at_ms, count(*) AS n, sum(floor((until - at_ms) / {4 * _HOUR}) + 1)::BIGINT AS emissions FROM y GROUP BY stream, at_ms
""")
def repeat_periodically(spark: SparkSession, d: str) -> DataFrame:
    # rows of one instant follow each other at once, so their number and what the last of them repeats are compared
    once = _arrivals(spark, d).groupBy("stream", "at_ms").agg(F.count("*").alias("n"))
    out = folds.repeat_periodically(once, ["stream"], "at_ms", 4 * _HOUR, 0)
    return out.groupBy("stream", "at_ms", "n").agg(F.count("*").alias("e")).select("stream", "at_ms", "n", (F.col("e") + F.col("n") - 1).alias("emissions"))


@query("SELECT o_orderstatus, max(o_orderkey) AS o_orderkey, arg_max(o_custkey, o_orderkey) AS o_custkey FROM orders GROUP BY o_orderstatus")
def checkpoint_combine(spark: SparkSession, d: str) -> DataFrame:
    return entities.latest_offsets(_table(spark, d, "orders"), "o_orderstatus", "o_orderkey", ["o_custkey"])


@query("SELECT coalesce(floor((epoch_us(TIMESTAMP '2030-01-01 00:00:00') - epoch_us(min(ts))) / 1000), 0)::BIGINT AS latency_ms FROM events")
def earliest_ts_latency(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency_ms(_table(spark, d, "events"), "ts", F.to_timestamp(F.lit("2030-01-01 00:00:00")))


@query("""
SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 'disconnected' WHEN c_custkey % 2 = 0 AND c_acctbal > 5000 THEN 'lagging' WHEN c_custkey % 2 <> 0 AND c_nationkey * 400 > 5000 THEN 'inactive' ELSE 'healthy' END AS status FROM customer
""")
def health_state(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("latency"), (F.col("c_nationkey") * 400).alias("idle"), (F.col("c_custkey") % 2 == 0).alias("busy"), (F.col("c_nationkey") != 0).alias("connected"))
    return metrics.health(rows, "latency", "idle", "busy", "connected", 5000).select("c_custkey", "status")


def _hour() -> F.Column:
    return F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / _HOUR)


_HOURS = f"h AS (SELECT floor((epoch_us(ts) // 1000) / {_HOUR})::BIGINT AS period, * FROM events)"


@query(f"""
WITH {_HOURS}, b AS (SELECT min(period) AS lo, max(period) AS hi FROM h)
SELECT p.period, coalesce(v.value, 0)::BIGINT AS value FROM (SELECT unnest(range(lo, hi + 1)) AS period FROM b) p
LEFT JOIN (SELECT period, count(*) AS value FROM h WHERE event_type = 'purchase' GROUP BY period) v ON p.period = v.period
""")
def metrics_counter(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "events").withColumn("period", _hour().cast("long"))
    periods = rows.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("period"))
    return metrics.counters(rows.filter("event_type = 'purchase'"), F.col("period"), periods, F.lit(1))


@query(f"WITH {_HOURS} SELECT period, greatest(max(value - 50), 0) AS value FROM h GROUP BY period")
def metrics_gauge(spark: SparkSession, d: str) -> DataFrame:
    return metrics.gauges(_table(spark, d, "events"), _hour().cast("long"), F.col("value") - 50)


@query(f"WITH {_HOURS} SELECT period, greatest(max(value), max(user_id % 100)::DOUBLE) AS value FROM h GROUP BY period")
def metrics_timer(spark: SparkSession, d: str) -> DataFrame:
    return metrics.timers(_table(spark, d, "events"), _hour().cast("long"), F.col("value"), (F.col("user_id") % 100).cast("double"))


@query("SELECT 'app.' || event_type || ':' || count(*)::VARCHAR || '|c|#env:test' AS line FROM events GROUP BY event_type")
def statsd_lines(spark: SparkSession, d: str) -> DataFrame:
    counts = _table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("kind", F.lit("counter"))
    return metrics.statsd_lines(counts, "app.", "event_type", "n", "kind", {"env": "test"})


@query("""
WITH x AS (SELECT doc_id, octet_length(encode(text)) AS n, text FROM documents)
SELECT doc_id, n >= 3000 AS replaced, n::INT AS actual FROM x
""")
def badrow_truncate(spark: SparkSession, d: str) -> DataFrame:
    data = F.encode("text", "UTF-8")
    out = deadletters.with_max_size(data, "loader", 3000)
    decoded = F.from_json(F.decode(out, "UTF-8"), "kind string, payload string, actual int")
    # of a replaced row: its payload must be the text's start, within a tenth of the limit
    fine = F.startswith("text", decoded["payload"]) & (F.octet_length(decoded["payload"]) <= 300) & (F.octet_length(decoded["payload"]) > 296)
    replaced = out != data
    actual = F.when(~replaced, F.octet_length(data)).when(fine, decoded["actual"])
    return _table(spark, d, "documents").select("doc_id", replaced.alias("replaced"), actual.alias("actual"))


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'zstd' WHEN 1 THEN 'gzip' ELSE 'plain' END AS codec FROM documents
""")
def sniff_codec(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("28B52FFD"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("1F8B"))).otherwise(F.unhex(F.lit("28B52F")))
    return _table(spark, d, "documents").select("doc_id", codec(F.concat(head, F.encode("text", "UTF-8"))).alias("codec"))


@query("""
SELECT source, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS n_bytes, sum(('0x' || substr(md5(text), 1, 12))::BIGINT::HUGEINT)::VARCHAR AS digest FROM documents GROUP BY source
""")
def compress_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("source", "doc_id", F.encode("text", "UTF-8").alias("body"))
    # null texts have no payload to pack, and a payload over the target goes on as it is
    each = docs.filter("body IS NULL").select("source", F.col("body").alias("payload"))
    for kind, rest in (("gzip", 0), ("zstd", 1)):
        own = docs.filter(F.col("body").isNotNull() & (F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(0)) == rest))
        # a source that has most rows is packed by as many tasks as others
        own = own.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(32)))
        packed = codecs.compress(own, ["source", "part"], ["doc_id"], "body", kind, 400_000).withColumn("ordinal", F.xxhash64("source", "part", "message_no"))
        # a record's length has 31 bits; an error is a row without a payload, and so is seen
        read = codecs.decompress(packed.filter("rejected IS NULL"), codecs.Limits(10**6, (1 << 31) - 1), "message", "ordinal")
        each = each.unionByName(read.join(packed.select("ordinal", "source"), "ordinal").select("source", "payload"))
        each = each.unionByName(packed.filter("rejected IS NOT NULL").select("source", F.col("rejected").alias("payload")))
    # a sum has no order, so partial ones are made before the shuffle
    word = F.conv(F.substring(F.md5("payload"), 1, 12), 16, 10).cast("decimal(20,0)")
    return each.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).cast("long").alias("n_bytes"), F.sum(word).cast("string").alias("digest"))


def _packed_tens(spark: SparkSession, d: str, kind: str, rows: F.Column) -> DataFrame:
    """Messages of up to ten documents each: tenth, message."""
    docs = _table(spark, d, "documents").filter(rows).select((F.floor(F.col("doc_id") / 10)).cast("long").alias("tenth"), "doc_id", F.encode("text", "UTF-8").alias("body"))
    return codecs.compress(docs, ["tenth"], ["doc_id"], "body", kind, 1 << 30).select("tenth", "message")


@query("""
WITH d AS (SELECT doc_id // 10 AS tenth, octet_length(encode(coalesce(text, ''))) AS b FROM documents)
SELECT 'gzip' AS codec, CASE WHEN b > 5000 THEN 'Payload will exceed maximum allowed size of 5000 after gzip decompression' ELSE 'none' END AS error, count(*) AS n FROM d GROUP BY ALL
UNION ALL SELECT 'gzip', 'corrupt gzip-compressed payload', count(DISTINCT tenth) FROM d WHERE tenth % 4 IN (1, 2) HAVING count(*) > 0
""")
def decompress_errors(spark: SparkSession, d: str) -> DataFrame:
    """Broken messages made from documents: payloads too large, a cut stream, junk at the end; records before a break are kept."""
    packed = _packed_tens(spark, d, "gzip", F.lit(True))
    n = F.octet_length("message")
    broken = F.when(F.col("tenth") % 4 == 1, F.substring("message", F.lit(1), n - 9)).when(F.col("tenth") % 4 == 2, F.concat("message", F.lit(b"junk!"))).otherwise(F.col("message"))
    out = codecs.decompress(packed.select(F.col("tenth").alias("ordinal"), broken.alias("payload")), codecs.Limits(10**5, 5000))
    return out.groupBy("codec", F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


@query("""
WITH RECURSIVE d AS (SELECT doc_id % 3 AS kind, doc_id, octet_length(encode(coalesce(text, ''))) AS b, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS k FROM documents),
w AS (SELECT *, CASE WHEN b > 30000 THEN 0 ELSE b END AS s FROM d WHERE kind < 2),
f AS (
  SELECT kind, k, b, s, 0::BIGINT AS part, CASE WHEN s > 20000 THEN 0 ELSE s END::BIGINT AS total, (s > 20000)::BIGINT AS after FROM w WHERE k = 1
  UNION ALL
  SELECT w.kind, w.k, w.b, w.s, f.after, CASE WHEN f.total + w.s > 20000 THEN 0 ELSE f.total + w.s END, f.after + (f.total + w.s > 20000)::BIGINT
  FROM f JOIN w ON w.kind = f.kind AND w.k = f.k + 1),
p AS (
  SELECT kind, part, count(*) AS n, sum((b > 30000)::BIGINT) AS errors, sum(s) AS bytes FROM f GROUP BY ALL
  UNION ALL SELECT -1, 0, count(*), 0, sum(b) FROM d WHERE kind = 2 HAVING count(*) > 0),
q AS (SELECT *, row_number() OVER (ORDER BY kind, part) - 1 AS batch_no, count(*) OVER () - 1 AS last FROM p)
SELECT CASE kind WHEN -1 THEN 'plain' WHEN 0 THEN 'zstd' ELSE 'gzip' END AS codec, batch_no::BIGINT AS batch_no, batch_no = last AS is_last, n::BIGINT AS n_records, errors::BIGINT AS n_errors, bytes::BIGINT AS n_bytes FROM q
""")
def decompressed_batches(spark: SparkSession, d: str) -> DataFrame:
    """A source batch of plain and compressed messages, decompressed and split into batches by the soft limit."""
    rest = F.pmod(F.col("doc_id"), F.lit(3))
    messages = _table(spark, d, "documents").filter(rest == 2).select(F.col("doc_id").alias("ordinal"), F.encode("text", "UTF-8").alias("payload"))
    for kind, k in (("zstd", 0), ("gzip", 1)):
        messages = messages.unionByName(_packed_tens(spark, d, kind, rest == k).select(F.col("tenth").alias("ordinal"), F.col("message").alias("payload")))
    out = codecs.decompressed_batches(messages, codecs.Limits(20_000, 30_000))
    size = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")
    return out.groupBy("codec", "batch_no", "is_last").agg(F.count("*").alias("n_records"), F.count("error").alias("n_errors"), F.sum(size).alias("n_bytes"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN '{"k":' || json_extract_string(props, '$.k') || ',"_schema_version":"1-0-2"}' ELSE '[1]' END AS data FROM events
""")
def schema_version_added(spark: SparkSession, d: str) -> DataFrame:
    key = schema_key(F.when(F.col("event_id") % 3 == 1, "schema:com.acme/x/jsonschema/1-0-2"))
    data = F.when(F.col("event_id") % 3 == 2, F.lit("[1]")).otherwise(F.col("props"))
    out = F.when(F.col("event_id") % 3 == 0, data).otherwise(with_schema_version(data, key))
    return _table(spark, d, "events").select("event_id", out.alias("data"))
