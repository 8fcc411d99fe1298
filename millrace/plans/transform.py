"""Events to wide rows: a projection generated from a batch's column types.

All of it is expressions, so a batch is read once and nothing is shuffled. JSON is parsed to
VARIANT and every leaf's own type is checked before it is cast, as casts alone would be lenient.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import Criterion, bound, schema_key, skipped, version_text, without_skipped
from ..functions.values import money, money_ok
from .atomic import atomic_fields
from .schemas import Failure, Family, Field, Resolved
from .strict import NO_ERRORS, absent, checked, each, errors_of, pair, quoted

def with_schema_version(data: Column, key: Column) -> Column:
    """An entity's JSON text with ``_schema_version`` set, over one it may have; what is no object stays."""
    pieces = F.struct(F.try_parse_json(data).alias("variant"), version_text(key).alias("version"), data.alias("data"))
    return bound(pieces, lambda e: F.when(F.schema_of_variant(e["variant"]).startswith("OBJECT"), _versioned(e["variant"], e["version"])).otherwise(e["data"]))


def _versioned(v: Column, text: Column) -> Column:
    fields = F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    own = F.map_filter(fields, lambda k, _: k != "_schema_version")
    return F.to_json(F.map_concat(own, F.create_map(F.lit("_schema_version"), F.try_parse_json(F.concat(F.lit('"'), text, F.lit('"'))))))


def _versioned_text(v: str, version: str) -> str:
    """The same as SQL."""
    fields = f"coalesce(try_variant_get({v}, '$', 'map<string,variant>'), CAST(map() AS map<string,variant>))"
    return f"to_json(map_concat(map_filter({fields}, (_k, _v) -> _k <> '_schema_version'), map('_schema_version', try_parse_json(concat('\"', {version}, '\"')))))"


_ENVELOPES = "array<struct<schema:string,data:string>>"


@dataclass(frozen=True)
class _Target:
    """A column of the result: what it is made of, and by which versions."""

    field: Field
    family: Family
    versions: tuple[tuple[int, int], ...]

    @property
    def source(self) -> str:
        latest = max(self.versions, default=(0, 0))
        return f"{self.family.vendor}/{self.family.name}/{self.family.model}-{latest[0]}-{latest[1]}"

    def names(self) -> list[str]:
        return [f"{self.family.vendor}/{self.family.name}/{self.family.model}-{r}-{a}" for r, a in self.versions]


def _numbers(named: list[list[str]], name: Column) -> Column:
    """The number of the list that holds a name, by a literal map."""
    pairs = [x for k, names in enumerate(named) for n in names for x in (F.lit(n), F.lit(k))]
    return F.try_element_at(F.create_map(*pairs), name) if pairs else F.lit(None).cast("int")


def _dispatched(envelopes: Column, skip: list[Criterion], targets: list[_Target], failures: list[Failure]) -> Column:
    """Array of (target, failure, version, data) of the envelopes that no criterion skips; a key is taken apart once."""
    keyed = F.transform(envelopes, lambda e: F.struct(schema_key(e["schema"]).alias("key"), e["data"].alias("data")))
    kept = F.filter(keyed, lambda e: ~skipped(e["key"], skip)) if skip else keyed
    name = lambda k: F.concat(k["vendor"], F.lit("/"), k["name"], F.lit("/"), version_text(k))
    named = F.transform(kept, lambda e: F.struct(name(e["key"]).alias("name"), version_text(e["key"]).alias("version"), e["data"].alias("data")))
    failed = [_Target(None, f.family, tuple(f.versions)).names() for f in failures]
    target, failure = ((lambda n, x=x: _numbers(x, n)) for x in ([t.names() for t in targets], failed))
    return F.transform(named, lambda e: F.struct(target(e["name"]).alias("target"), failure(e["name"]).alias("failure"), e["version"].alias("version"), e["data"].alias("data")))


def _parsed(dispatched: Column) -> Column:
    """Array of (target, version, variant, is_object) of the envelopes that have a target; their JSON is parsed here and nowhere else."""
    own = F.filter(dispatched, lambda e: e["target"].isNotNull())
    # parsed JSON is an object if its text begins as one
    begins = lambda d: F.coalesce(d.rlike(r"^\s*\{"), F.lit(False))
    return F.transform(own, lambda e: F.struct(e["target"].alias("target"), e["version"].alias("version"), F.try_parse_json(e["data"]).alias("variant"), begins(e["data"]).alias("is_object")))


def _values(parsed: str, k: int, target: _Target) -> Column:
    """Array of (value, errors) of the entities of a target in a column of parsed ones."""
    if target.family.kind == "unstruct_event":
        kind, nullable, known = target.field.type, False, False
    else:
        kind, nullable, known = target.field.type.element, target.field.type.element_nullable, True

    def one(e: str) -> str:
        if known and kind == "json":
            text = f"CASE WHEN {e}.is_object THEN {_versioned_text(f'{e}.variant', f'{e}.version')} ELSE to_json({e}.variant) END"
            return f"CASE WHEN {absent(f'{e}.variant')} THEN {checked(f'{e}.variant', kind, nullable, target.source)} ELSE {pair(text, NO_ERRORS)} END"
        # the version is the key's, whatever the entity has under that name
        return checked(f"{e}.variant", kind, nullable, target.source, {"_schema_version": f"{e}.version"} if known else None, f"{e}.is_object")

    return F.expr(each(f"filter({parsed}, _e -> _e.target = {k})", one))


def atomic_columns(df: DataFrame) -> tuple[list[Column], Column]:
    """The 128 columns in order, absent ones null, and the errors of money that would be rounded."""
    columns, errors = [], []
    for f in atomic_fields():
        if f.name not in df.columns:
            # as one text: many columns are absent, and every call costs the driver time
            columns.append(F.expr(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`"))
        elif isinstance(f.dataType, T.DecimalType):
            x = F.col(f.name).cast("double")
            columns.append(money(x).alias(f.name))
            wrong = F.expr(errors_of(quoted(f.name), f"concat('WrongType(', CAST(CAST(`{f.name}` AS double) AS string), ',Decimal(18,2))')"))
            errors.append(F.when(money_ok(x), F.expr(NO_ERRORS)).otherwise(wrong))
        else:
            columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return columns, F.concat(*errors) if errors else F.expr(NO_ERRORS)


def transform_events(df: DataFrame, resolved: Resolved, skip: list[Criterion] | None = None, load_tstamp: Column | None = None) -> DataFrame:
    """Wide rows: the atomic columns, a column for each resolved family and its recoveries, and ``errors``.

    ``df`` has atomic columns, ``unstruct_event`` struct(schema, data) and the arrays ``contexts``
    and ``derived_contexts`` of such; data is JSON text. A row is good if ``errors`` is empty. An
    event that holds a family or version that failed to resolve has just those failures; others
    accumulate all their errors. A version that a family does not take leaves its column null.

    Keys are taken apart and JSON is parsed once an entity: each step is a column that the next one reads.
    """
    kinds = ("unstruct_event", "contexts")
    targets = {kind: [] for kind in kinds}
    placed = []  # (kind, number) of each column in order
    for c in resolved.columns:
        for field, versions in [(c.field, sorted(c.versions)), *((f, [v]) for v, f in c.recoveries)]:
            placed.append((c.family.kind, len(targets[c.family.kind])))
            targets[c.family.kind].append(_Target(field, c.family, tuple(versions)))
    failures = {kind: [f for f in resolved.failures if f.family.kind == kind] for kind in kinds}

    one = F.col("unstruct_event").cast("struct<schema:string,data:string>") if "unstruct_event" in df.columns else F.lit(None).cast("struct<schema:string,data:string>")
    single = F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast(_ENVELOPES))
    several = [F.coalesce(F.col(c).cast(_ENVELOPES), F.array().cast(_ENVELOPES)) for c in ("contexts", "derived_contexts") if c in df.columns]
    envelopes = {"unstruct_event": single, "contexts": F.concat(*several) if several else F.array().cast(_ENVELOPES)}
    atomic, errors = atomic_columns(df)
    if load_tstamp is not None:
        atomic.append(load_tstamp.cast("timestamp").alias("load_tstamp"))
    names = [f.name for f in atomic_fields()] + ["load_tstamp"] * (load_tstamp is not None)
    # a criterion never hides an event of its own: its versions are not resolved
    out = df.select(*atomic, errors.alias("_errors"), *[_dispatched(envelopes[k], (skip or []) if k == "contexts" else [], targets[k], failures[k]).alias(f"_{k}") for k in kinds])
    out = out.withColumns({f"_{k}_parsed": _parsed(F.col(f"_{k}")) for k in kinds})
    out = out.withColumns({f"_values_{k}_{n}": _values(f"_{k}_parsed", n, t) for k in kinds for n, t in enumerate(targets[k])})
    columns, all_errors = [], [F.col("_errors")]
    for kind, n in placed:
        own = F.col(f"_values_{kind}_{n}")
        # no entity gives null, not an empty array
        value = F.get(own, 0)["value"] if kind == "unstruct_event" else F.when(F.size(own) > 0, F.transform(own, lambda x: x["value"]))
        columns.append(value.alias(targets[kind][n].field.name))
        all_errors.append(F.flatten(F.transform(own, lambda x: x["errors"])))
    # a filter on the errors brings all of this below itself, so keys are named once a kind here, whatever the number of failures
    missing = F.concat(*[_failed(F.col(f"_{kind}"), failures[kind]) for kind in kinds if failures[kind]]) if resolved.failures else None
    all_ = F.concat(*all_errors)
    errors = all_ if missing is None else F.coalesce(bound(missing, lambda m: F.when(F.size(m) > 0, m).otherwise(all_)), F.expr(NO_ERRORS))
    return out.select(*names, *columns, errors.alias("errors"))


def _failed(dispatched: Column, failures: list[Failure]) -> Column:
    """The errors of the failures that any of the entities has, one each, in order of the failures."""
    messages = F.array(*[F.expr(errors_of(quoted(f.family.column), quoted(f.message))) for f in failures])
    held = F.filter(F.transform(dispatched, lambda e: e["failure"]), lambda n: n.isNotNull())
    return F.flatten(F.transform(F.array_sort(F.array_distinct(held)), lambda n: F.get(messages, n)))


def transform_unstructured(df: DataFrame, skip: list[Criterion] | None = None) -> DataFrame:
    """Atomic columns, ``entities`` (column name -> JSON text) and ``errors``, without a registry.

    Context columns hold the array of their entities with ``_schema_version``; where contexts and
    derived contexts have one column, the derived ones replace the others.
    """
    columns, errors = atomic_columns(df)
    empty = F.array().cast("array<struct<schema:string,data:string>>")
    snake = lambda c: F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(c, r"\.", "_"), "([^A-Z_])([A-Z])", "$1_$2")), "[^a-z0-9_]", "_")

    def column(kind: str, key: Column) -> Column:
        return F.concat_ws("_", F.lit(kind), snake(key["vendor"]), snake(key["name"]), key["model"].cast("string"))

    def grouped(name: str) -> Column:
        if name not in df.columns:
            return F.create_map().cast("map<string,string>")
        kept = without_skipped(F.coalesce(F.col(name).cast("array<struct<schema:string,data:string>>"), empty), skip or [])
        named = F.transform(kept, lambda e: F.struct(column("contexts", schema_key(e["schema"])).alias("c"), with_schema_version(e["data"], schema_key(e["schema"])).alias("d")))
        names = F.array_distinct(F.transform(named, lambda x: x["c"]))
        own = lambda n: F.concat(F.lit("["), F.array_join(F.transform(F.filter(named, lambda x: x["c"] == n), lambda x: x["d"]), ","), F.lit("]"))
        return F.map_from_arrays(names, F.transform(names, own))

    maps = [grouped("contexts"), grouped("derived_contexts")]
    later = reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b), maps)
    if "unstruct_event" in df.columns:
        e = F.col("unstruct_event")
        one = without_skipped(F.when(e.isNotNull(), F.array(e.cast("struct<schema:string,data:string>"))).otherwise(empty), skip or [])
        later = F.map_concat(later, F.map_from_arrays(F.transform(one, lambda x: column("unstruct_event", schema_key(x["schema"]))), F.transform(one, lambda x: x["data"])))
    return df.select(*columns, later.alias("entities"), errors.alias("errors"))
