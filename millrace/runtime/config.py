"""Configuration: JSON or TOML files, environment variables and checked scalars."""

from __future__ import annotations

import dataclasses
import json
import os
import re
import tomllib
from collections.abc import Mapping
from typing import Any, TypeVar
from urllib.parse import urlparse

C = TypeVar("C")


def truthy(value: Any) -> bool:
    """A boolean, or text that says yes (fixed values)."""
    return value if isinstance(value, bool) else str(value).strip().lower() in ("true", "yes", "on", "1")


def port(value: Any) -> int:
    n = int(value)
    if not 0 < n < 65536:
        raise ValueError(f"not a port: {value}")
    return n


def uri(value: str) -> str:
    if not (parts := urlparse(value)).scheme or not parts.netloc:
        raise ValueError(f"not an absolute address: {value}")
    return value


#: Milliseconds of the units of time (fixed values).
_UNITS = {"ms": 1, "milli": 1, "millis": 1, "millisecond": 1, "s": 1000, "sec": 1000, "second": 1000, "m": 60_000, "min": 60_000, "minute": 60_000, "h": 3_600_000, "hour": 3_600_000, "d": 86_400_000, "day": 86_400_000}


def duration_ms(value: Any) -> int:
    """Milliseconds of a number of them, or of text as ``10 seconds``, ``1.5 minutes`` or ``250ms``; not negative."""
    if isinstance(value, int | float) and not isinstance(value, bool):
        found = float(value)
    else:
        m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)\s*", str(value).lower())
        unit = m and (_UNITS.get(m[2] or "ms") or _UNITS.get(m[2].removesuffix("s")))
        if not unit:
            raise ValueError(f"not a duration: {value}")
        found = float(m[1]) * unit
    if found < 0:
        raise ValueError(f"not a duration: {value}")
    return round(found)


def substitute(value: Any, env: Mapping[str, str], settings: Mapping | None = None, within: tuple[str, ...] = ()) -> Any:
    """``${a.b}`` by the setting of that path, or ``${NAME}`` by the environment's value, required, and ``${?NAME}`` by either or nothing.

    Text that is a single reference takes the setting's own value, of whatever type.
    """
    if isinstance(value, dict):
        return {k: substitute(v, env, settings, within) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env, settings, within) for v in value]
    if not isinstance(value, str):
        return value
    reference = r"\$\{(\?)?([A-Za-z_][A-Za-z0-9_.-]*)\}"

    def one(m: re.Match) -> Any:
        if m[2] in within:
            raise ValueError(f"{m[2]} refers to itself")
        found: Any = settings
        for part in m[2].split("."):
            found = found.get(part) if isinstance(found, Mapping) else None
        if found is not None:
            return substitute(found, env, settings, (*within, m[2]))
        if m[2] not in env and not m[1]:
            raise ValueError(f"{m[2]} is not set")
        return env.get(m[2], "")

    whole = re.fullmatch(reference, value)
    return one(whole) if whole else re.sub(reference, lambda m: str(one(m)), value)


def merged(base: Mapping, over: Mapping) -> dict:
    """``over`` laid on ``base``, table by table."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load(path: str, defaults: Mapping = {}, namespace: str | None = None, env: Mapping[str, str] | None = None) -> dict:
    """A file over defaults; a table named ``namespace`` overrides the rest."""
    with open(path, "rb") as f:
        data = tomllib.load(f) if path.endswith(".toml") else json.load(f)
    own = data.pop(namespace, {}) if namespace else {}
    settings = merged(merged(defaults, data), own)
    return substitute(settings, os.environ if env is None else env, settings)


def build(kind: type[C], data: Mapping) -> C:
    """A dataclass from a mapping; unknown and missing keys are errors."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := set(data) - set(fields):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    missing = [n for n, f in fields.items() if n not in data and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    return kind(**data)


def optional(kind: type[C], data: Mapping | None) -> C | None:
    """None where all required settings are missing: the part is switched off. Some of them missing is an error."""
    data = data or {}
    required = [f.name for f in dataclasses.fields(kind) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
    return None if all(not data.get(n) for n in required) else build(kind, data)
