"""Sources by configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import http
from .broker import ShardedSource
from .limits import KafkaSource


def open_source(spark: SparkSession, config: dict) -> DataFrame:
    """A stream from ``{"http": {...}}``, ``{"kafka": {...}}`` or ``{"sharded": {...}}``.

    A bare broker configuration (with a ``client``) is a sharded one; ``http`` wins where both are given.
    Kafka needs Spark's connector on the class path.
    """
    if config.get("http"):
        return http.read_stream(spark, **config["http"])
    if config.get("kafka"):
        return spark.readStream.format("kafka").options(**KafkaSource(**config["kafka"]).options()).load()
    sharded = config.get("sharded", config)
    if "client" not in sharded:
        raise ValueError("no source is configured")
    spark.dataSource.register(ShardedSource)
    return spark.readStream.format("sharded").options(**sharded).load()
