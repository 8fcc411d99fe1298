"""Metrics by period, their StatsD and text forms, and webhook messages."""

from __future__ import annotations

import json
import socket
import threading
import urllib.request
from collections.abc import Callable


class Metrics:
    """Counters, gauges and timers since the last report.

    Counters report their sum and are then 0; gauges and timers report their largest value, at
    least 0, and nothing while untouched. A timer's alternative is asked at each report.
    """

    def __init__(self):
        self._lock = threading.Lock()
        self._counters: dict[str, float] = {}
        self._maxima: dict[str, float] = {}
        self._alternatives: dict[str, Callable[[], float | None]] = {}

    def counter(self, name: str) -> Callable[[float], None]:
        self._counters.setdefault(name, 0)

        def add(n: float = 1) -> None:
            with self._lock:
                self._counters[name] += n

        return add

    def gauge(self, name: str) -> Callable[[float], None]:
        def see(value: float) -> None:
            with self._lock:
                self._maxima[name] = max(self._maxima.get(name, 0), value)

        return see

    def timer(self, name: str, alternative: Callable[[], float | None] = lambda: None) -> Callable[[float], None]:
        self._alternatives[name] = alternative
        return self.gauge(name)

    def report(self) -> list[tuple[str, float, str]]:
        with self._lock:
            counts, maxima = dict(self._counters), dict(self._maxima)
            self._counters, self._maxima = dict.fromkeys(self._counters, 0), {}
        for name, ask in self._alternatives.items():
            if (other := ask()) is not None:
                maxima[name] = max(maxima.get(name, 0), other)
        return [(k, v, "c") for k, v in counts.items()] + [(k, v, "g") for k, v in maxima.items()]


def statsd(report: list[tuple[str, float, str]], prefix: str = "", tags: dict[str, str] | None = None) -> list[str]:
    dotted = prefix.strip().rstrip(".") + "." if prefix.strip() else ""
    tail = "|#" + ",".join(f"{k}:{v}" for k, v in tags.items()) if tags else ""
    return [f"{dotted}{name}:{value:g}|{kind}{tail}" for name, value, kind in report]


def send_statsd(lines: list[str], host: str, port: int) -> None:
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for line in lines:
            s.sendto(line.encode(), (host, port))


def exposition(report: list[tuple[str, float, str]]) -> str:
    """Text for a scraping collector."""
    kind = {"c": "counter", "g": "gauge"}
    return "".join(f"# TYPE {n} {kind[k]}\n{n} {v:g}\n" for n, v, k in ((name.replace(".", "_"), v, k) for name, v, k in report))


def jvm_report(spark) -> list[tuple[str, float, str]]:
    """Memory, threads and garbage collection of the driver's JVM, as a report to expose beside the metrics."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory
    memory, threads = beans.getMemoryMXBean(), beans.getThreadMXBean()
    out = [("jvm.threads", threads.getThreadCount(), "g"), ("jvm.uptime_ms", beans.getRuntimeMXBean().getUptime(), "c")]
    for name, use in (("heap", memory.getHeapMemoryUsage()), ("nonheap", memory.getNonHeapMemoryUsage())):
        out += [(f"jvm.{name}.used_bytes", use.getUsed(), "g"), (f"jvm.{name}.committed_bytes", use.getCommitted(), "g")]
    collectors = list(beans.getGarbageCollectorMXBeans())
    return [*out, ("jvm.gc.count", sum(c.getCollectionCount() for c in collectors), "c"), ("jvm.gc.time_ms", sum(c.getCollectionTime() for c in collectors), "c")]


def webhook_body(event: str, app: str, version: str, message: str | None = None, tags: dict[str, str] | None = None, limit: int = 4096) -> bytes:
    """Heartbeat or alert as JSON; a message is cut to ``limit`` characters."""
    data = {"event": event, "application": f"{app}-{version}", "tags": tags or {}}
    if message is not None:
        data["message"] = message[:limit]
    return json.dumps(data).encode()


class Webhook:
    """Posts a heartbeat when setup becomes healthy and every ``period`` seconds after it, and an alert when it fails.

    What cannot be posted is dropped: reporting never stops the application.
    """

    def __init__(self, send: Callable[[bytes], None], app: str, version: str, period: float = 300.0, tags: dict[str, str] | None = None):
        self.send, self.app, self.version, self.period, self.tags = send, app, version, period, tags
        self._timer: threading.Timer | None = None

    @classmethod
    def to(cls, url: str, *args, **kwargs) -> Webhook:
        def post(body: bytes) -> None:
            urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=10).close()

        return cls(post, *args, **kwargs)

    def __call__(self, state: str, alert: str | None) -> None:
        self.close()
        if state == "awaiting":
            return
        try:
            self.send(webhook_body("heartbeat" if state == "healthy" else "alert", self.app, self.version, alert, self.tags))
        except Exception:
            pass
        self._timer = threading.Timer(self.period, self, (state, alert))
        self._timer.daemon = True
        self._timer.start()

    def close(self) -> None:
        if self._timer:
            self._timer.cancel()
