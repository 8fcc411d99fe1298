"""Dead letters: rows that say what failed and carry the payload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD_ROW = "struct<kind string, processor string, message string, payload binary>"


def bad_row(kind: str, processor: str, message: Column, payload: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(processor).alias("processor"), message.alias("message"), payload.alias("payload"))


def utf8_prefix(data: Column, n: int) -> Column:
    """The first ``n`` bytes of UTF-8 text, less a character that would be cut in two."""
    cut = F.substring(data, 1, n)
    # a character whose bytes go on after the cut is dropped
    ends = F.coalesce(F.hex(F.substring(data, n + 1, 1)), F.lit(""))
    inside = (ends >= "80") & (ends < "C0")
    lead = lambda k: (F.hex(F.substring(data, n + 1 - k, 1)) >= "C0") | (F.hex(F.substring(data, n + 1 - k, 1)) < "80")
    drop = F.when(~inside, 0).when(lead(1), 1).when(lead(2), 2).when(lead(3), 3).otherwise(0)
    return F.when(F.octet_length(data) <= n, data).otherwise(F.substring(cut, F.lit(1), F.greatest(F.lit(n) - drop, F.lit(0))))


def with_max_size(serialized: Column, processor: str, max_size: int) -> Column:
    """Serialized bytes of a bad row, or a size violation in its place.

    At ``max_size`` bytes or more the row is replaced by one that keeps the first
    ``max_size // 10`` bytes of it, whole characters only, as its payload.
    """
    short = F.decode(utf8_prefix(serialized, max_size // 10), "UTF-8")
    violation = F.to_json(F.struct(F.lit("size_violation").alias("kind"), F.lit(processor).alias("processor"), F.lit("Badrow exceeds allowed max size").alias("message"), F.lit(max_size).alias("maximum"), F.octet_length(serialized).alias("actual"), short.alias("payload")))
    return F.when(F.octet_length(serialized) >= max_size, F.encode(violation, "UTF-8")).otherwise(serialized)


def too_large_message(limit: int, codec: str) -> str:
    return f"Payload will exceed maximum allowed size of {limit} after {codec} decompression"


def bad_rows(decompressed: DataFrame, to_bad_row: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """The application's bad rows of decompressed messages: ``to_bad_row(message, timestamp, payload)``, the payload in base64."""
    made = to_bad_row(F.col("error"), F.current_timestamp(), F.base64("original"))
    return decompressed.filter("error IS NOT NULL").select(made.alias("bad_row"))
