"""What each kind of broker takes in one request, and names of its resources."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..runtime.config import uri


@dataclass(frozen=True)
class RequestLimits:
    max_records: int
    max_bytes: int
    max_record_bytes: int | None = None
    counts_key: bool = False


# Limits of the brokers' interfaces (fixed values).
KINESIS = RequestLimits(500, 5_242_880, 1_000_000, counts_key=True)
PUBSUB = RequestLimits(1000, 1_000_000, 9_000_000)
NSQ = RequestLimits(1 << 31, 5_000_000)
KAFKA = RequestLimits(1 << 31, 1 << 62, 1_000_000)

POSITIONS = {"LATEST": "latest", "TRIM_HORIZON": "earliest", "AT_TIMESTAMP": "timestamp", "Latest": "latest", "TrimHorizon": "earliest", "AtTimestamp": "timestamp"}


def initial_position(name: str, timestamp_ms: int | None = None) -> tuple[str, int | None]:
    """Where to begin, from either spelling; a timestamp is needed by, and only by, that position."""
    kind = POSITIONS.get(name)
    if kind is None or (kind == "timestamp") != (timestamp_ms is not None):
        raise ValueError(f"not an initial position: {name}")
    return kind, timestamp_ms


def resource_name(kind: str, text: str) -> tuple[str, str]:
    """(project, id) of ``projects/<p>/topics/<t>`` or ``projects/<p>/subscriptions/<s>``."""
    m = re.fullmatch(rf"projects/([^/]+)/{kind}/([^/]+)", text)
    if not m:
        raise ValueError(f"not of the form projects/<project>/{kind}/<name>: {text}")
    return m[1], m[2]


@dataclass(frozen=True)
class KafkaSource:
    """Settings of a Kafka stream; ``options`` are those of Spark's own reader."""

    bootstrap_servers: str
    topic: str
    consumer: tuple[tuple[str, str], ...] = ()
    starting: str = "latest"

    def options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.bootstrap_servers, "subscribe": self.topic, "startingOffsets": self.starting} | {f"kafka.{k}": v for k, v in self.consumer}


@dataclass(frozen=True)
class KafkaSink:
    bootstrap_servers: str
    topic: str
    max_record_bytes: int = 1_000_000
    producer: tuple[tuple[str, str], ...] = ()

    def options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.bootstrap_servers, "topic": self.topic, "kafka.max.request.size": str(self.max_record_bytes), "includeHeaders": "true"} | {f"kafka.{k}": v for k, v in self.producer}


@dataclass(frozen=True)
class HttpSink:
    base: str

    def address(self) -> str:
        return uri(self.base).rstrip("/") + "/input"
