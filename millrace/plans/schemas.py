"""Column types of schema families: registry, merging of versions, recovery columns.

A micro-batch names the families and versions it holds, a small result. The driver looks their
schemas up, merges each family's versions into one column type, and gives a version that cannot be
merged a recovery column of its own. The types then make the batch's projection.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import types as T

from ..functions.keys import Criterion
from ..functions.values import entity_column, snake_case_text


@dataclass(frozen=True)
class Field:
    """A column or a property: ``source`` is the property's own name."""

    name: str
    type: object
    nullable: bool
    source: str = ""


@dataclass(frozen=True)
class Struct:
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class Array:
    element: object
    element_nullable: bool


@dataclass(frozen=True)
class Decimal:
    precision: int
    scale: int


#: Leaf types by name; ``json`` keeps any value as JSON text.
LEAVES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType(), "json": T.StringType()}


def spark_type(t: object) -> T.DataType:
    if isinstance(t, Struct):
        return T.StructType([T.StructField(f.name, spark_type(f.type), f.nullable) for f in t.fields])
    if isinstance(t, Array):
        return T.ArrayType(spark_type(t.element), t.element_nullable)
    if isinstance(t, Decimal):
        return T.DecimalType(t.precision, t.scale)
    return LEAVES[t]


class InvalidSchema(ValueError):
    pass


def field_of(name: str, schema: Mapping, required: bool) -> Field | None:
    """Field of a JSON schema; None for an object that can hold nothing.

    Rules that are our own: a type list with ``null`` is nullable; integers whose bounds fit 32
    bits are ``int``; ``date`` and ``date-time`` formats give dates and timestamps; any other mix
    of types, and objects with neither properties nor a ban on others, are JSON.
    """
    if not isinstance(schema, Mapping):
        raise InvalidSchema(f"the schema of {name} is no object")
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    nullable = not required or "null" in kinds
    kinds = [k for k in kinds if k != "null"]
    make = lambda t: Field(snake_case_text(name), t, nullable, name)
    if kinds == ["object"]:
        properties = schema.get("properties", {})
        if not isinstance(properties, Mapping):
            raise InvalidSchema(f"properties of {name} is no object")
        wanted = schema.get("required", [])
        found = [field_of(k, v, k in wanted) for k, v in sorted(properties.items())]
        found = tuple(f for f in found if f is not None)
        if found:
            # required properties first, each part in order of name
            return make(Struct(tuple(sorted(found, key=lambda f: (f.nullable, f.name)))))
        return None if schema.get("additionalProperties", True) is False else make("json")
    if kinds == ["array"]:
        items = schema.get("items")
        element = field_of("element", items, True) if isinstance(items, Mapping) else None
        return make(Array(element.type, element.nullable) if element else Array("json", True))
    if kinds == ["string"]:
        return make({"date": "date", "date-time": "timestamp"}.get(schema.get("format"), "string"))
    if kinds == ["integer"]:
        lo, hi = schema.get("minimum"), schema.get("maximum")
        return make("int" if lo is not None and hi is not None and -(2**31) <= lo and hi < 2**31 else "long")
    if kinds in (["number"], ["integer", "number"], ["number", "integer"]):
        return make("double")
    if kinds == ["boolean"]:
        return make("boolean")
    return make("json")


def merge(a: Field, b: Field) -> Field | None:
    """One field for both, or None: equal types stay, structs merge by property; a field that either lacks is nullable.

    Fields of ``a`` keep their order and those that only ``b`` has follow by name.
    """
    merged = _merge_types(a.type, b.type)
    return None if merged is None else replace(a, type=merged, nullable=a.nullable or b.nullable)


def _merge_types(a: object, b: object) -> object | None:
    if isinstance(a, Struct) and isinstance(b, Struct):
        theirs = {f.name: f for f in b.fields}
        out = []
        for f in a.fields:
            g = theirs.pop(f.name, None)
            m = merge(f, g) if g else replace(f, nullable=True)
            if m is None:
                return None
            out.append(m)
        return Struct((*out, *(replace(g, nullable=True) for _, g in sorted(theirs.items()))))
    if isinstance(a, Array) and isinstance(b, Array):
        element = _merge_types(a.element, b.element)
        return None if element is None else Array(element, a.element_nullable or b.element_nullable)
    return a if a == b else None


@dataclass(frozen=True, order=True)
class Family:
    """All versions of a model, as an event of its own (``unstruct_event``) or as context entities (``contexts``)."""

    kind: str
    vendor: str
    name: str
    model: int

    @property
    def column(self) -> str:
        return entity_column(self.kind, self.vendor, self.name, self.model)


Version = tuple[int, int]


@dataclass(frozen=True)
class EntityColumn:
    """A resolved family: its column, the versions that it takes, and a column for each version that it cannot take."""

    family: Family
    field: Field
    versions: frozenset[Version]
    recoveries: tuple[tuple[Version, Field], ...]


@dataclass(frozen=True)
class Failure:
    family: Family
    versions: frozenset[Version]
    message: str


@dataclass(frozen=True)
class Resolved:
    columns: tuple[EntityColumn, ...]
    failures: tuple[Failure, ...]


class ClashingColumnNames(ValueError):
    def __init__(self, clashes: list[list[Family]]):
        super().__init__("families share a column name: " + "; ".join(", ".join(map(str, c)) for c in clashes))
        self.clashes = clashes


class Registry:
    """Schemas by (vendor, name, model, revision, addition)."""

    def __init__(self, schemas: Mapping[tuple[str, str, int, int, int], Mapping]):
        self.schemas = dict(schemas)

    def up_to(self, family: Family, version: Version) -> list[tuple[Version, Mapping]]:
        """All versions of the model up to one, in order; KeyError if that one is missing."""
        own = sorted(((r, a), s) for (v, n, m, r, a), s in self.schemas.items() if (v, n, m) == (family.vendor, family.name, family.model) and (r, a) <= version)
        if not own or own[-1][0] != version:
            raise KeyError(f"no schema {family.vendor}/{family.name}/{family.model}-{version[0]}-{version[1]}")
        return own


def _column_field(family: Family, schema: Mapping) -> Field | None:
    root = field_of(family.column, schema, False)
    if root is None:
        return None
    if family.kind != "contexts":
        return replace(root, name=family.column, nullable=True)
    element = root.type
    if isinstance(element, Struct):
        element = Struct((Field("_schema_version", "string", False, "_schema_version"), *element.fields))
        return Field(family.column, Array(element, False), True)
    return Field(family.column, Array(element, True), True)


def recovery_name(column: str, model: int, version: Version, schema: Mapping) -> str:
    """Column name of a version of its own; the hash is crc32 of the schema's canonical JSON."""
    text = json.dumps(schema, sort_keys=True, separators=(",", ":"))
    return f"{column}_recovered_{model}_{version[0]}_{version[1]}_{zlib.crc32(text.encode()):08x}"


def build(family: Family, versions: Iterable[Version], schemas: list[tuple[Version, Mapping]]) -> EntityColumn | None:
    """Merge a family's versions in order; None if none of them can hold anything.

    The first version that has a column is the root. One that does not merge goes to a recovery
    column, if the batch holds it.
    """
    found = [(v, f, s) for v, s in schemas if (f := _column_field(family, s)) is not None]
    if not found:
        return None
    (first, field, _), *rest = found
    merged, recoveries, held = {first}, [], set(versions)
    for version, own, schema in rest:
        joined = merge(field, own)
        if joined is not None:
            field = replace(joined, name=family.column)
            merged.add(version)
        elif version in held:
            recoveries.append((version, replace(own, name=recovery_name(family.column, family.model, version, schema))))
    return EntityColumn(family, field, frozenset(merged), tuple(recoveries))


def _skips(c: Criterion, f: Family, v: Version) -> bool:
    own = (f.vendor, f.name, f.model, *v)
    return all(want is None or want == got for want, got in zip((c.vendor, c.name, c.model, c.revision, c.addition), own))


def resolve_family(family: Family, versions: Iterable[Version], registry: Registry, skip: Iterable[Criterion] = ()) -> tuple[EntityColumn | None, Failure | None]:
    """A family's column or its failure; neither if no version is left or none can hold anything.

    Skipped versions are left out before lookup and again from the merged versions.
    """
    skip = list(skip)
    kept = frozenset(v for v in versions if not any(_skips(c, family, v) for c in skip))
    if not kept:
        return None, None
    try:
        column = build(family, kept, registry.up_to(family, max(kept)))
    except KeyError as e:
        return None, Failure(family, kept, str(e.args[0]))
    except InvalidSchema as e:
        return None, Failure(family, kept, f"invalid schema: {e}")
    if column is None:
        return None, None
    return replace(column, versions=frozenset(v for v in column.versions if not any(_skips(c, family, v) for c in skip))), None


def clashing(columns: Iterable[EntityColumn]) -> None:
    """Two families with one column name are an error."""
    by_name: dict[str, list[Family]] = {}
    for c in columns:
        by_name.setdefault(c.field.name, []).append(c.family)
    if clashes := [f for f in by_name.values() if len(f) > 1]:
        raise ClashingColumnNames(clashes)


def resolve(families: Mapping[Family, Iterable[Version]], registry: Registry, skip: Iterable[Criterion] = ()) -> Resolved:
    """Types of a batch's families, or their failures. Two families with one column name fail the whole batch."""
    found = [resolve_family(family, versions, registry, skip) for family, versions in sorted(families.items())]
    columns = [c for c, _ in found if c is not None]
    clashing(columns)
    return Resolved(tuple(columns), tuple(f for _, f in found if f is not None))
