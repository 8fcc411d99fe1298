"""Strict values: money without rounding, column names, codec signatures."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_ok(amount: Column, precision: int = 18, scale: int = 2) -> Column:
    """Whether a double is exactly a decimal of that precision and scale; null is, NaN is not."""
    cast = amount.try_cast(f"decimal({precision},{scale})")
    return amount.isNull() | F.coalesce(cast.cast("double") == amount, F.lit(False))


def money(amount: Column, precision: int = 18, scale: int = 2) -> Column:
    """The decimal where it is exact, else null."""
    return F.when(money_ok(amount, precision, scale), amount.try_cast(f"decimal({precision},{scale})"))


def snake_case(name: Column) -> Column:
    """Column name of a property: camelCase to snake_case, other characters to ``_``, a leading digit after ``_``."""
    out = F.regexp_replace(name, "([^A-Z_])([A-Z])", "$1_$2")
    out = F.regexp_replace(F.lower(out), "[^a-z0-9_]", "_")
    return F.regexp_replace(out, "^([0-9])", "_$1")


def snake_case_text(name: str) -> str:
    """``snake_case`` on the driver."""
    out = re.sub(r"([^A-Z_])([A-Z])", r"\1_\2", name)
    return re.sub(r"^([0-9])", r"_\1", re.sub(r"[^a-z0-9_]", "_", out.lower()))


def entity_column(kind: str, vendor: str, name: str, model: int) -> str:
    """``unstruct_event_...`` or ``contexts_...`` column of a family."""
    return f"{kind}_{snake_case_text(vendor.replace('.', '_'))}_{snake_case_text(name)}_{model}"


#: Signatures of the two codecs (fixed values).
ZSTD, GZIP = b"\x28\xb5\x2f\xfd", b"\x1f\x8b"


def codec(payload: Column) -> Column:
    """``zstd`` or ``gzip`` by the first bytes, else ``plain``; null and short payloads are plain."""
    starts = lambda sign: F.coalesce(F.startswith(payload, F.lit(sign)), F.lit(False))
    return F.when(starts(ZSTD), "zstd").when(starts(GZIP), "gzip").otherwise("plain")
