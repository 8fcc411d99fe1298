"""Families, versions and routing: what a batch of events holds and which rows are good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import Criterion, schema_key, skipped, version


def families(df: DataFrame, uri: str = "schema", by: list[str] | None = None) -> DataFrame:
    """The schema families of a batch: vendor, name, model, versions (sorted) and their latest, apart for each value of ``by``.

    Families and versions are few, so this is a small result whatever the batch. Values that are
    no key belong to no family.
    """
    by = by or []
    # texts are few as well, and only theirs are taken apart
    keyed = df.select(*by, F.col(uri).alias("uri")).distinct().select(*by, schema_key(F.col("uri")).alias("k")).filter("k IS NOT NULL")
    once = keyed.select(*by, "k.vendor", "k.name", "k.model", version(F.col("k")).alias("v")).distinct()
    return once.groupBy(*by, "vendor", "name", "model").agg(F.array_sort(F.collect_list("v")).alias("versions")).withColumn("latest", F.array_max("versions"))


def entity_uris(df: DataFrame, columns: list[str]) -> DataFrame:
    """All schema URIs of events as column ``schema``, and in ``kind`` whether they are of single envelopes (unstruct_event) or of arrays of them (contexts)."""

    def marked(c: str) -> Column:
        several = df.schema[c].dataType.typeName() == "array"
        uris = F.col(c)["schema"] if several else F.array(F.col(c)["schema"])
        kind = F.lit("contexts" if several else "unstruct_event").alias("kind")
        return F.transform(F.coalesce(uris, F.array().cast("array<string>")), lambda u: F.struct(kind, u.alias("schema")))

    return df.select(F.inline(F.concat(*map(marked, columns)))).filter("schema IS NOT NULL")


def skip_entities(df: DataFrame, criteria: list[Criterion], uri: str = "schema") -> DataFrame:
    """Rows whose key no criterion matches; what is no key is never skipped."""
    return df.filter(~skipped(schema_key(F.col(uri)), criteria))


def clashes(names: DataFrame, name: str, column: Column) -> DataFrame:
    """Column names that two or more different ``name`` values get: column_name, n, members (sorted)."""
    once = names.select(F.col(name).alias("member"), column.alias("column_name")).distinct()
    return once.groupBy("column_name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("member")).alias("members")).filter("n > 1")


def versions_up_to(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """Registry rows of the wanted models whose version is at most the wanted one, and whether that one exists.

    Both have vendor, name, model, revision, addition; the result is the registry's rows with
    ``requested`` set to the wanted version as text.
    """
    w = wanted.select("vendor", "name", "model", F.col("revision").alias("_r"), F.col("addition").alias("_a"))
    upto = F.struct("revision", "addition") <= F.struct("_r", "_a")
    return registry.join(w, ["vendor", "name", "model"]).filter(upto).withColumn("requested", F.concat_ws("-", F.col("model").cast("string"), F.col("_r").cast("string"), F.col("_a").cast("string"))).drop("_r", "_a")


def route(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad rows by an array of errors; persist the input if both are used. A null array is no error."""
    marked = df.withColumn("errors", F.coalesce(errors, F.array()))
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def latest_offsets(df: DataFrame, partition: str, offset: str, payload: list[str] | None = None) -> DataFrame:
    """The commit of a batch: per partition the row of the largest offset. Partial results merge before the shuffle."""
    rest = [F.max_by(c, offset).alias(c) for c in payload or []]
    return df.groupBy(partition).agg(F.max(offset).alias(offset), *rest)


def total_bytes(df: DataFrame, payload: str) -> DataFrame:
    """Rows and bytes of a binary or string column; nulls have none."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)).cast("long").alias("n_bytes"))
