"""Schema keys, families and skip criteria as expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEY = r"^[a-z][a-z0-9+.-]*:([a-zA-Z0-9-_.]+)/([a-zA-Z0-9-_]+)/([a-zA-Z0-9-_]+)/([0-9]+)-([0-9]+)-([0-9]+)$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def schema_key(uri: Column) -> Column:
    """Struct (vendor, name, format, model, revision, addition) of ``scheme:vendor/name/format/M-R-A``; null if it is no key."""
    made = lambda p, v: F.struct(
        F.substring_index(F.get(p, 0), ":", -1).alias("vendor"), F.get(p, 1).alias("name"), F.get(p, 2).alias("format"),
        *[F.get(v, k).try_cast("int").alias(x) for k, x in enumerate(("model", "revision", "addition"))],
    )
    # no part has a slash, and only the scheme ends in a colon
    return F.when(uri.rlike(_KEY), bound(F.split(uri, "/"), lambda p: bound(F.split(F.get(p, 3), "-"), lambda v: made(p, v))))


def version(key: Column) -> Column:
    """Struct (revision, addition); structs order by their fields, so array_max is the latest."""
    return F.struct(key["revision"].alias("revision"), key["addition"].alias("addition"))


def version_text(key: Column) -> Column:
    return F.concat_ws("-", key["model"].cast("string"), key["revision"].cast("string"), key["addition"].cast("string"))


def key_matches(key: Column, vendor: str, name: str, model: int, versions: list[tuple[int, int]]) -> Column:
    """Whether a key is of a family and of one of its versions; null keys match nothing."""
    inside = reduce(lambda a, b: a | b, [(key["revision"] == r) & (key["addition"] == a) for r, a in versions], F.lit(False))
    return F.coalesce((key["vendor"] == vendor) & (key["name"] == name) & (key["model"] == model) & inside, F.lit(False))


@dataclass(frozen=True)
class Criterion:
    """``scheme:vendor/name/format/A-B-C`` where B and C, or all three, may be ``*``."""

    vendor: str
    name: str
    format: str
    model: int | None
    revision: int | None
    addition: int | None

    @classmethod
    def parse(cls, text: str) -> Criterion:
        m = re.match(r"^[a-z][a-z0-9+.-]*:([^/]+)/([^/]+)/([^/]+)/([0-9]+|\*)-([0-9]+|\*)-([0-9]+|\*)$", text)
        if not m:
            raise ValueError(f"not a schema criterion: {text}")
        numbers = [None if x == "*" else int(x) for x in m.groups()[3:]]
        if (numbers[0] is None and numbers[1] is not None) or (numbers[1] is None and numbers[2] is not None):
            raise ValueError(f"a version part after a wildcard must be a wildcard: {text}")
        return cls(*m.groups()[:3], *numbers)

    def matches(self, key: Column) -> Column:
        tests = [(key[f] == getattr(self, f)) for f in ("vendor", "name", "format", "model", "revision", "addition") if getattr(self, f) is not None]
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def skipped(key: Column, criteria: list[Criterion]) -> Column:
    """Whether any criterion matches."""
    return reduce(lambda a, b: a | b, [c.matches(key) for c in criteria], F.lit(False))


def without_skipped(entities: Column, criteria: list[Criterion]) -> Column:
    """An array of (schema, data) structs without those that a criterion matches."""
    return F.filter(entities, lambda e: ~skipped(schema_key(e["schema"]), criteria)) if criteria else entities
