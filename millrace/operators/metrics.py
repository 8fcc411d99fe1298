"""Metrics by report period, latency and health as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(df: DataFrame, period: Column, periods: DataFrame, value: Column) -> DataFrame:
    """Sum per report period; quiet periods report 0. ``periods`` has every period in column ``period``."""
    sums = df.groupBy(period.alias("period")).agg(F.sum(value).alias("value"))
    return periods.join(sums, "period", "left").select("period", F.coalesce("value", F.lit(0)).alias("value"))


def gauges(df: DataFrame, period: Column, value: Column) -> DataFrame:
    """Largest value per period, at least 0; periods without values report nothing."""
    return df.groupBy(period.alias("period")).agg(F.max(value).alias("value")).select("period", F.greatest("value", F.lit(0)).alias("value"))


def timers(df: DataFrame, period: Column, value: Column, alternative: Column) -> DataFrame:
    """Largest duration per period, or the alternative maximum where that is larger."""
    return df.groupBy(period.alias("period")).agg(F.max(value).alias("value"), F.max(alternative).alias("other")).select("period", F.greatest("value", "other").alias("value"))


def latency_ms(df: DataFrame, source_ts: str, now: Column) -> DataFrame:
    """Milliseconds from the earliest source timestamp to now; 0 for a batch without timestamps."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    earliest = df.agg(F.min(source_ts).alias("t"))
    return earliest.select(F.coalesce(F.floor((micros(now) - micros(F.col("t"))) / 1000), F.lit(0)).cast("long").alias("latency_ms"))


def health(df: DataFrame, latency: str, idle: str, busy: str, connected: str, max_latency_ms: int) -> DataFrame:
    """Append ``status`` of source states: disconnected, lagging, inactive or healthy.

    A source that has a batch out (``busy``) lags if that took longer than allowed; an idle one is
    inactive if nothing came for longer than allowed. Exactly the limit is healthy.
    """
    status = (
        F.when(~F.col(connected), "disconnected")
        .when(F.col(busy) & (F.col(latency) > max_latency_ms), "lagging")
        .when(~F.col(busy) & (F.col(idle) > max_latency_ms), "inactive")
        .otherwise("healthy")
    )
    return df.withColumn("status", status)


def statsd_lines(df: DataFrame, prefix: str, name: str, value: str, kind: str, tags: dict[str, str]) -> DataFrame:
    """StatsD wire lines ``prefix.name:value|g|#k:v``; counters have ``c`` for ``g``."""
    tail = "|#" + ",".join(f"{k}:{v}" for k, v in sorted(tags.items())) if tags else ""
    dotted = prefix.rstrip(".") + "." if prefix else ""
    mark = F.when(F.col(kind) == "counter", "c").otherwise("g")
    return df.select(F.concat(F.lit(dotted), F.col(name), F.lit(":"), F.col(value).cast("string"), F.lit("|"), mark, F.lit(tail)).alias("line"))
