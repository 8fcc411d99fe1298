"""Variants as strictly typed values: SQL text made from a column's type.

Text, not Column calls, as a type of many fields would need thousands of those, each of which costs the driver time in every
micro-batch. A part that is named several times is bound to a lambda's variable, as an expression inside a lambda is run wherever it is named.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schemas import Array, Decimal, Struct, spark_type

ERRORS = "array<struct<source string, message string>>"
NO_ERRORS = f"CAST(array() AS {ERRORS})"

#: Types of a variant that a leaf takes, as ``schema_of_variant`` names them. A fraction such as 1.0 is no integer.
_TAKES = {"string": "= 'STRING'", "boolean": "= 'BOOLEAN'", "int": "= 'BIGINT'", "long": "= 'BIGINT'", "double": "RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$'", "timestamp": "= 'STRING'", "date": "= 'STRING'"}

_numbers = count()


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(value: str, use) -> str:
    """``use(name)`` with the value worked out once."""
    name = f"_x{next(_numbers)}"
    return f"get(transform(array({value}), {name} -> {use(name)}), 0)"


def each(values: str, use) -> str:
    name = f"_x{next(_numbers)}"
    return f"transform({values}, {name} -> {use(name)})"


def pair(value: str, errors: str) -> str:
    return f"named_struct('value', {value}, 'errors', {errors})"


def absent(v: str) -> str:
    return f"({v} IS NULL OR is_variant_null({v}))"


def errors_of(source: str, message: str) -> str:
    """An array of one error; both are SQL."""
    return f"CAST(array(named_struct('source', {source}, 'message', {message})) AS {ERRORS})"


def _name(t: object) -> str:
    if isinstance(t, Struct):
        return "Struct"
    if isinstance(t, Array):
        return "Array"
    return f"Decimal({t.precision},{t.scale})" if isinstance(t, Decimal) else t.capitalize()


def checked(v: str, t: object, nullable: bool, source: str, known: dict[str, str] | None = None, is_object: str | None = None) -> str:
    """Struct (value, errors) of a variant as a type, without conversions; missing and JSON null are null.

    ``known`` gives fields of a struct that are not taken from the variant, ``is_object`` whether it is an object, where that is known.
    """
    wrong = lambda x: errors_of(quoted(source), f"concat('WrongType(', coalesce(to_json({x}), 'null'), {quoted(f',{_name(t)})')})")
    none = f"CAST(NULL AS {spark_type(t).simpleString()})"

    def cases(x: str, fits: str, good: str) -> str:
        return f"CASE WHEN {absent(x)} THEN {pair(none, NO_ERRORS if nullable else wrong(x))} WHEN {fits} THEN {good} ELSE {pair(none, wrong(x))} END"

    if isinstance(t, Struct):
        return bound(v, lambda x: cases(x, f"coalesce({is_object or _kind(x, 'OBJECT')}, false)", _fields(x, t, source, known or {})))
    if isinstance(t, Array):
        elements = lambda x: each(f"try_variant_get({x}, '$', 'array<variant>')", lambda y: checked(y, t.element, t.element_nullable, source))
        good = lambda x: bound(elements(x), lambda y: pair(each(y, lambda z: f"{z}.value"), f"flatten({each(y, lambda z: f'{z}.errors')})"))
        return bound(v, lambda x: cases(x, f"coalesce({_kind(x, 'ARRAY')}, false)", good(x)))
    return bound(v, lambda x: bound(_leaf(x, t), lambda y: cases(x, f"{y}.fits", pair(f"{y}.value", NO_ERRORS))))


def _kind(x: str, name: str) -> str:
    return f"startswith(schema_of_variant({x}), '{name}')"


def _fields(x: str, t: Struct, source: str, known: dict[str, str]) -> str:
    taken = [f for f in t.fields if f.name not in known]
    parts = []
    for k, f in enumerate(taken):
        # by the property's own name, or by the column's
        paths = [f.source or f.name, f.name] if f.source not in ("", f.name) else [f.name]
        found = ", ".join(f"try_variant_get({x}, {quoted(_path(p))}, 'variant')" for p in paths)
        parts.append(f"'f{k}', " + checked(f"coalesce({found})", f.type, f.nullable, source))
    at = {f.name: k for k, f in enumerate(taken)}

    def made(y: str) -> str:
        values = ", ".join(f"{quoted(f.name)}, " + (known[f.name] if f.name in known else f"{y}.f{at[f.name]}.value") for f in t.fields)
        return pair(f"named_struct({values})", f"concat({', '.join([NO_ERRORS, *(f'{y}.f{k}.errors' for k in range(len(taken)))])})")

    return bound(f"named_struct({', '.join(parts)})", made) if taken else made("")


def _path(name: str) -> str:
    return f"$['{name}']"


def _leaf(x: str, t: object) -> str:
    """Struct (value, fits)."""
    if t == "json":
        return f"named_struct('value', to_json({x}), 'fits', true)"
    if isinstance(t, Decimal):
        target, number = f"decimal({t.precision},{t.scale})", f"try_variant_get({x}, '$', 'double')"
        cast = f"try_cast({number} AS {target})"
        return f"named_struct('value', {cast}, 'fits', coalesce(schema_of_variant({x}) RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$' AND CAST({cast} AS double) = {number}, false))"
    value = f"try_variant_get({x}, '$', '{spark_type(t).simpleString()}')"
    return f"named_struct('value', {value}, 'fits', coalesce(schema_of_variant({x}) {_TAKES[t]} AND {value} IS NOT NULL, false))"


def strict(v: str, t: object, nullable: bool, source: str) -> tuple[Column, Column]:
    """(value, errors) of a variant, which is given as SQL, as a type."""
    both = F.expr(checked(v, t, nullable, source))
    return both["value"], both["errors"]
