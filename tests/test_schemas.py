import json
import re

import pytest
from millrace.functions.keys import Criterion
from millrace.plans import schemas as S
from millrace.plans.atomic import atomic_fields, money_fields
from millrace.plans.strict import strict
from millrace.plans.transform import transform_events, transform_unstructured, with_schema_version
from pyspark.sql import functions as F

OBJ = lambda required=(), **p: {"type": "object", "properties": {k: {"type": t} if isinstance(t, str) else t for k, t in p.items()}, "required": list(required)}
DATE = {"type": "string", "format": "date"}
REGISTRY = S.Registry({
    # an orchard's pickings: every version adds, one of them two properties and a list
    ("orchard", "picking", 2, 0, 0): OBJ(["row", "weight"], row="integer", weight="number"),
    ("orchard", "picking", 2, 0, 3): OBJ(["row", "weight", "picker"], row="integer", weight="number", picker="string"),
    ("orchard", "picking", 2, 4, 0): OBJ(["row", "weight"], row="integer", weight="number", day=DATE, baskets={"type": "array", "items": {"type": "integer"}}),
    ("orchard", "picking", 2, 4, 2): OBJ(["row"], row="integer", weight="number", ripe="boolean"),
    # a press whose pressure changes its type twice and then comes back
    ("orchard", "press", 3, 0, 0): OBJ(["pressure", "litres"], pressure="integer", litres="number"),
    ("orchard", "press", 3, 1, 0): OBJ(["pressure"], pressure="string"),
    ("orchard", "press", 3, 1, 1): OBJ(["pressure", "litres"], pressure={"type": "array", "items": {"type": "number"}}, litres="number"),
    ("orchard", "press", 3, 2, 0): OBJ(["litres"], litres="number", press_date=DATE),
    # properties in another order than their names, and nested ones that both versions add to
    ("orchard", "label", 5, 2, 0): OBJ(["zone"], zone="string", bottle=OBJ(["size"], size="integer"), acid="number"),
    ("orchard", "label", 5, 2, 7): OBJ(["zone"], zone="string", bottle=OBJ(["size", "glass"], size="integer", glass="string"), batchNo="integer"),
    ("orchard", "odd-names", 1, 0, 0): OBJ(["2ndPress"], **{"2ndPress": "boolean", "pHValue": "number"}),
    ("orchard", "sealed", 4, 0, 0): {"type": "object", "additionalProperties": False},
    ("orchard", "sealed", 4, 0, 1): {"type": "object", "properties": {}, "additionalProperties": False},
    ("orchard", "sealed", 4, 1, 0): OBJ(sealDate=DATE),
    ("orchard", "note", 9, 0, 0): {"type": "object"},
    ("orchard", "torn", 6, 0, 0): {"type": "object", "properties": [1, 2]},
    ("cider-mill", "tank", 1, 1, 0): OBJ(level="number"),
    ("cider_mill", "tank", 1, 0, 4): OBJ(level="number"),
    ("cider.mill", "tank", 2, 0, 0): OBJ(level="number"),
})


def one(name, model, versions, kind="unstruct_event", vendor="orchard", skip=()):
    return S.resolve({S.Family(kind, vendor, name, model): versions}, REGISTRY, skip)


def shape(field):
    t = field.type
    return [(f.name, f.type, f.nullable) for f in t.fields] if isinstance(t, S.Struct) else t


def test_merged_versions():
    """Versions up to the latest of the batch; what any of them lacks or leaves free is nullable, and new fields follow by name."""
    c = one("picking", 2, [(0, 0)]).columns[0]
    assert shape(c.field) == [("row", "long", False), ("weight", "double", False)] and c.versions == {(0, 0)}
    # the batch holds just the third version: those between are merged as well, the later one is not
    c = one("picking", 2, [(4, 0)]).columns[0]
    assert shape(c.field) == [("row", "long", False), ("weight", "double", False), ("picker", "string", True), ("baskets", S.Array("long", False), True), ("day", "date", True)]
    assert c.versions == {(0, 0), (0, 3), (4, 0)} and c.field.name == "unstruct_event_orchard_picking_2" and c.field.nullable
    c = one("picking", 2, [(0, 3), (4, 2)]).columns[0]
    assert [f[0] for f in shape(c.field)] == ["row", "weight", "picker", "baskets", "day", "ripe"] and [f[2] for f in shape(c.field)] == [False, True, True, True, True, True]
    # nested properties merge in the same way
    c = one("label", 5, [(2, 7)]).columns[0]
    assert [f[0] for f in shape(c.field)] == ["zone", "acid", "bottle", "batch_no"]
    bottle = shape(c.field)[2][1]
    assert [(f.name, f.type, f.nullable) for f in bottle.fields] == [("size", "long", False), ("glass", "string", True)]


def test_recovery_columns():
    """A version whose types do not merge has a column of its own, if the batch holds it."""
    c = one("press", 3, [(0, 0), (1, 0), (1, 1), (2, 0)]).columns[0]
    assert shape(c.field) == [("litres", "double", False), ("pressure", "long", True), ("press_date", "date", True)] and c.versions == {(0, 0), (2, 0)}
    assert [(v, shape(f)) for v, f in c.recoveries] == [((1, 0), [("pressure", "string", False)]), ((1, 1), [("litres", "double", False), ("pressure", S.Array("double", False), False)])]
    assert all(re.fullmatch(r"unstruct_event_orchard_press_3_recovered_3_1_[01]_[0-9a-f]{8}", f.name) for _, f in c.recoveries)
    c = one("press", 3, [(1, 1)]).columns[0]
    assert [v for v, _ in c.recoveries] == [(1, 1)] and c.versions == {(0, 0)}
    assert one("press", 3, [(2, 0)]).columns[0].recoveries == ()


def test_names_empty_open_and_context_columns():
    fields = one("odd-names", 1, [(0, 0)]).columns[0].field.type.fields
    assert [(f.name, f.source) for f in fields] == [("_2nd_press", "2ndPress"), ("p_hvalue", "pHValue")]
    # nothing can be held until the third version
    assert one("sealed", 4, [(0, 0), (0, 1)]).columns == ()
    c = one("sealed", 4, [(1, 0)]).columns[0]
    assert c.versions == {(1, 0)} and shape(c.field) == [("seal_date", "date", True)]
    assert one("note", 9, [(0, 0)]).columns[0].field.type == "json"
    assert one("note", 9, [(0, 0)], "contexts").columns[0].field.type == S.Array("json", True)
    t = one("picking", 2, [(0, 0)], "contexts").columns[0].field.type
    assert t.element.fields[0] == S.Field("_schema_version", "string", False, "_schema_version") and not t.element_nullable
    assert [f.name for f in t.element.fields] == ["_schema_version", "row", "weight"]


def test_failures_clashes_and_skipping():
    assert "no schema orchard/picking/2-4-1" in one("picking", 2, [(0, 0), (4, 1)]).failures[0].message
    assert one("torn", 6, [(0, 0)]).failures[0].message.startswith("invalid schema")
    with pytest.raises(S.ClashingColumnNames) as e:
        S.resolve({S.Family("contexts", "cider-mill", "tank", 1): [(1, 0)], S.Family("contexts", "cider_mill", "tank", 1): [(0, 4)], S.Family("contexts", "cider.mill", "tank", 2): [(0, 0)]}, REGISTRY)
    assert [{f.vendor for f in c} for c in e.value.clashes] == [{"cider-mill", "cider_mill"}]
    skip = [Criterion.parse("schema:orchard/picking/jsonschema/2-0-*")]
    assert one("picking", 2, [(0, 0), (0, 3)], skip=skip).columns == ()
    assert one("picking", 2, [(0, 3), (4, 0)], skip=skip).columns[0].versions == {(4, 0)}


def test_atomic_columns():
    fields = atomic_fields(load_tstamp=True)
    assert len(fields) == 129 and [f.name for f in fields if not f.nullable] == ["collector_tstamp", "event_id", "v_collector", "v_etl", "load_tstamp"]
    assert len(money_fields()) == 8


ALL = S.Struct(tuple(S.Field(k, t, False) for k, t in {
    "sort": "string", "trees": "int", "drops": "long", "price": S.Decimal(7, 3), "sugar": "double", "organic": "boolean", "planted": "date",
    "watered": "timestamp", "yields": S.Array("double", False), "owner": S.Struct((S.Field("name", "string", False), S.Field("acres", "long", True))),
}.items()) + (S.Field("remark", "string", True),))
GOOD = {"sort": "Boskoop", "trees": 310, "drops": 9876543210987, "price": 41.125, "sugar": 0.0625, "organic": False, "planted": "1987-11-02", "watered": "2021-06-30T05:15:00Z", "yields": [1.5, 2, 0.25], "owner": {"name": "Ines", "acres": 12}, "remark": None}


def cast(spark, data, t):
    v, e = strict("try_parse_json(data)", t, False, "s")
    r = spark.createDataFrame([(data,)], "data string").select(v.alias("v"), e.alias("e")).first()
    return r.v, [x.message for x in r.e]


def test_strict_values(spark):
    value, errors = cast(spark, json.dumps(GOOD), ALL)
    assert errors == [] and (value.drops, str(value.price), value.yields, value.owner.name, value.owner.acres, value.remark) == (9876543210987, "41.125", [1.5, 2.0, 0.25], "Ines", 12, None)
    flag = S.Struct((S.Field("ripe", "boolean", False),))
    assert cast(spark, "{}", flag)[1] == ["WrongType(null,Boolean)"]
    assert cast(spark, '{"ripe":null}', flag)[1] == ["WrongType(null,Boolean)"]
    assert cast(spark, '{"ripe":"yes"}', flag)[1] == ['WrongType("yes",Boolean)']
    wrong = {"sort": ["a"], "trees": -(2**31) - 1, "drops": 0.5, "price": 1.0625, "sugar": True, "organic": 1, "planted": "autumn", "watered": {}, "yields": [1, None, "x"], "owner": {"acres": 3}}
    for k, bad in wrong.items():
        assert len(cast(spark, json.dumps(GOOD | {k: bad}), ALL)[1]) == (2 if k == "yields" else 1), k
    assert len(cast(spark, json.dumps(GOOD | {"trees": "many", "organic": 0, "owner": {"name": 5, "acres": "x"}}), ALL)[1]) == 4


EVENT = "event_id string, tr_total double, unstruct_event struct<schema:string,data:string>, contexts array<struct<schema:string,data:string>>, derived_contexts array<struct<schema:string,data:string>>"
U = lambda n, v, d: (f"schema:orchard/{n}/jsonschema/{v}", json.dumps(d))


def test_transform_events(spark):
    families = {S.Family("unstruct_event", "orchard", "press", 3): [(0, 0), (1, 0)], S.Family("contexts", "orchard", "picking", 2): [(0, 0), (4, 0)], S.Family("contexts", "orchard", "lost", 1): [(0, 0)]}
    resolved = S.resolve(families, REGISTRY)
    rows = [
        ("good", 80.05, U("press", "3-0-0", {"pressure": 7, "litres": 30.5}), [U("picking", "2-0-0", {"row": 4, "weight": 1.25})], [U("picking", "2-4-0", {"row": 5, "weight": 2, "day": "2020-09-01"})]),
        ("bad", 80.055, U("press", "3-0-0", {"pressure": "high", "litres": 1}), [U("picking", "2-0-0", {"row": 1})], None),
        ("recovered", None, U("press", "3-1-0", {"pressure": "low"}), [], None),
        ("failed", 80.055, None, [U("lost", "1-0-0", {})], None),
        ("unknown", None, U("press", "3-7-0", {"pressure": 1}), [U("other", "1-0-0", {})], []),
    ]
    out = transform_events(spark.createDataFrame(rows, EVENT), resolved, load_tstamp=F.current_timestamp())
    recovered = next(c for c in out.columns if "_recovered_" in c)
    got = {r.event_id: r for r in out.collect()}
    assert len(out.columns) == 129 + 3 + 1
    good = got["good"]
    assert good.errors == [] and str(good.tr_total) == "80.05" and good.unstruct_event_orchard_press_3.pressure == 7 and good[recovered] is None
    assert [(x._schema_version, x.row, x.weight, x.picker, str(x.day)) for x in good.contexts_orchard_picking_2] == [("2-0-0", 4, 1.25, None, "None"), ("2-4-0", 5, 2.0, None, "2020-09-01")]
    # money, the pressure and the missing weight
    assert len(got["bad"].errors) == 3
    assert got["recovered"].errors == [] and got["recovered"][recovered].pressure == "low" and got["recovered"].unstruct_event_orchard_press_3 is None and got["recovered"].contexts_orchard_picking_2 is None
    assert [e.message for e in got["failed"].errors] == ["no schema orchard/lost/1-0-0"]
    assert got["unknown"].errors == [] and got["unknown"].unstruct_event_orchard_press_3 is None


def test_transform_unstructured(spark):
    rows = [("one", 1.0, U("lateFrost", "4-0-0", {"night": 3}), [U("tree", "2-0-0", {"age": 9}), U("tree", "2-1-0", {"age": 8}), U("bird", "1-0-0", "owl")], [U("tree", "2-0-5", {"age": 7})]), ("two", None, None, None, None)]
    got = {r.event_id: r.entities for r in transform_unstructured(spark.createDataFrame(rows, EVENT), [Criterion.parse("schema:orchard/bird/jsonschema/3-*-*")]).collect()}
    assert json.loads(got["one"]["unstruct_event_orchard_late_frost_4"]) == {"night": 3}
    assert json.loads(got["one"]["contexts_orchard_tree_2"]) == [{"age": 7, "_schema_version": "2-0-5"}]
    assert json.loads(got["one"]["contexts_orchard_bird_1"]) == ["owl"]
    assert got["two"] == {}


def test_schema_version_is_set_on_objects_only(spark):
    from millrace.functions.keys import schema_key

    key = schema_key(F.lit("schema:acme/x/jsonschema/1-0-2"))
    cases = {'{"a":1}': {"a": 1, "_schema_version": "1-0-2"}, '{"_schema_version":"9"}': {"_schema_version": "1-0-2"}, "[1]": [1], '"s"': "s", "5": 5, "null": None, "true": True, "{}": {"_schema_version": "1-0-2"}}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    for r in df.select("d", with_schema_version(F.col("d"), key).alias("o")).collect():
        assert json.loads(r.o) == cases[r.d]


def test_keys_and_json_are_taken_apart_once(spark, tmp_path):
    """However many families, versions and recoveries: one parse and one key for single events, and one for contexts."""
    registry = S.Registry({("orchard", n, 1, 0, a): {"type": "object", "properties": {"k": {"type": "string" if a == 2 else "integer"}}} for n in ("tree", "picking", "press") for a in range(4)})
    held = {S.Family(kind, "orchard", n, 1): [(0, a) for a in range(4)] for kind in ("unstruct_event", "contexts") for n in ("tree", "picking", "press")}
    (tmp_path / "events.json").write_text('{"event_id":"e"}')
    out = transform_events(spark.read.schema(EVENT).json(str(tmp_path)), S.resolve(held, registry), [Criterion.parse("schema:orchard/other/jsonschema/1-*-*")])
    assert sum("recovered" in c for c in out.columns) == 6
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # a kind's key is matched once, and so is whether its text begins an object
    assert plan.count("parseJson") == 2 and plan.count("RLIKE") == 4


def test_a_filter_on_errors_takes_keys_apart_once(spark):
    """However many families fail, a filter on the errors repeats no work on an event's key."""
    from millrace.plans import catalogue

    plan = catalogue.QUERIES["missing_schema_fail"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("RLIKE") <= 2
