import json
import random
import socket
import urllib.error
import urllib.request
from contextlib import contextmanager
from dataclasses import dataclass

import pytest
from millrace.runtime import config, retry
from millrace.runtime.coldswap import Coldswap
from millrace.runtime.health import AppHealth, serve_probe
from millrace.runtime.reporting import Metrics, Webhook, exposition, send_statsd, statsd, webhook_body


class Setup(Exception):
    pass


def check(e):
    return str(e) if isinstance(e, Setup) else None


def test_delays():
    take = lambda it, n: [next(it) for _ in range(n)]
    assert take(retry.exponential(1, 5), 5) == [1, 2, 4, 5, 5]
    assert take(retry.fibonacci(1, 6), 7) == [1, 1, 2, 3, 5, 6, 6]
    assert all(0 <= d <= m for d, m in zip(take(retry.full_jitter(1, 8, random.Random(2)), 6), [1, 2, 4, 8, 8, 8]))


def test_retries():
    slept, alerts, states = [], [], []
    how = dict(setup_check=check, setup_delay=1, transient_delay=1, attempts=3, alert=alerts.append, unhealthy=lambda: states.append("bad"), healthy=lambda: states.append("good"), sleep=slept.append)

    def setup(n):
        if n < 4:
            raise ValueError("outer") from Setup("no bucket")
        return n

    assert retry.with_retries(setup, **how) == 4
    assert slept == [1, 2, 4, 8] and alerts == ["no bucket"] * 4 and states == ["good"]
    calls = []

    def broken(n):
        calls.append(n)
        raise OSError("down")

    with pytest.raises(OSError):
        retry.with_retries(broken, **how)
    assert calls == [0, 1, 2] and states[1:] == ["bad"] * 3


def test_messages():
    assert retry.joined(["a", "a: b", "c", "b and c"]) == "a: b: b and c"
    assert retry.joined([]) == "" and retry.joined(["x", "x"]) == "x"
    assert retry.retryable("ABORTED") and not retry.retryable("INVALID_ARGUMENT")
    assert retry.retryable("UNAVAILABLE") and not retry.retryable("UNAVAILABLE", "Channel: Server shutdownNow invoked")


def test_app_health_and_probe():
    lag = []
    h = AppHealth([lambda: lag[0] if lag else None])
    changes = []
    h.on_setup_change(lambda s, a: changes.append((s, a)))
    server = serve_probe(h, 0, lambda: "m 1\n")
    get = lambda p="/": urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{p}").read().decode()

    def failing():
        with pytest.raises(urllib.error.HTTPError) as e:
            get()
        assert e.value.code == 503
        return e.value.read().decode()

    assert "awaited" in failing()
    h.setup_unhealthy("no table")
    assert "no table" in failing() and get("/metrics") == "m 1\n"
    h.service_healthy("writer")
    assert get() == "OK"
    h.service_unhealthy("writer")
    lag.append("the source is slow")
    assert failing() == "writer is unhealthy; the source is slow"
    assert changes == [("unhealthy", "no table"), ("healthy", None)]
    server.shutdown()


def test_metrics_report_and_reset():
    m = Metrics()
    other = [7.0]
    add, size, took = m.counter("n"), m.gauge("size"), m.timer("took", lambda: other[0])
    add(), add(4), size(3), size(-9), took(2)
    assert sorted(m.report()) == [("n", 5, "c"), ("size", 3, "g"), ("took", 7.0, "g")]
    other[0] = None
    assert m.report() == [("n", 0, "c")]
    size(-1)
    assert ("size", 0, "g") in m.report()
    assert statsd([("n", 5, "c"), ("x", 1.5, "g")], "app.", {"a": "b", "c": "d"}) == ["app.n:5|c|#a:b,c:d", "app.x:1.5|g|#a:b,c:d"]
    assert statsd([("n", 0, "c")]) == ["n:0|c"]
    assert exposition([("a.b", 2, "c")]) == "# TYPE a_b counter\na_b 2\n"
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(5)
        send_statsd(["n:1|c"], *s.getsockname())
        assert s.recv(100) == b"n:1|c"


def test_webhook():
    sent = []
    hook = Webhook(lambda b: sent.append(json.loads(b)), "app", "1.0", period=60)
    hook("awaiting", None)
    hook("unhealthy", "m" * 5000)
    hook("healthy", None)
    hook.close()
    assert [x["event"] for x in sent] == ["alert", "heartbeat"] and len(sent[0]["message"]) == 4096
    assert json.loads(webhook_body("alert", "a", "1", "x", {"t": "u"}))["tags"] == {"t": "u"}
    failing = Webhook(lambda b: 1 / 0, "app", "1.0", period=60)
    failing("healthy", None)
    failing.close()


@dataclass
class Sink:
    topic: str
    servers: str
    size: int = 5


def test_config(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"a": {"x": "${HOME_X}", "y": "${?NONE}"}, "own": {"a": {"z": 3}}}))
    (tmp_path / "b.toml").write_text('[a]\nx = 1\n')
    assert config.load(str(tmp_path / "a.json"), {"a": {"w": 0, "z": 1}}, "own", {"HOME_X": "here"}) == {"a": {"w": 0, "x": "here", "y": "", "z": 3}}
    assert config.load(str(tmp_path / "b.toml")) == {"a": {"x": 1}}
    with pytest.raises(ValueError, match="HOME_X"):
        config.load(str(tmp_path / "a.json"), env={})
    assert config.optional(Sink, {}) is None and config.optional(Sink, None) is None
    assert config.optional(Sink, {"topic": "t", "servers": "s"}).size == 5
    for bad in ({"topic": "t"}, {"topic": "t", "servers": "s", "more": 1}):
        with pytest.raises(ValueError):
            config.optional(Sink, bad)
    assert [config.truthy(x) for x in (True, "yes", "ON", "1", "no", "", "0", False)] == [True] * 4 + [False] * 4
    assert config.port("80") == 80 and config.uri("http://a/b") == "http://a/b"
    for f, x in ((config.port, 0), (config.port, 70000), (config.uri, "a/b")):
        with pytest.raises(ValueError):
            f(x)


def test_coldswap():
    log = []

    @contextmanager
    def make():
        log.append("open")
        yield len(log)
        log.append("close")

    c = Coldswap(make)
    with c.opened() as a, c.opened() as b:
        assert a == b == 1
    with c.closed():
        assert log == ["open", "close"]
    with c.opened() as a:
        assert a == 3
    c.close()
    c.close()
    assert log == ["open", "close", "open", "close"]


def test_durations_and_references(tmp_path):
    from millrace.runtime import config

    cases = {"10 seconds": 10_000, "250ms": 250, "1.5 minutes": 90_000, "2 h": 7_200_000, "1 day": 86_400_000, 30: 30, "30": 30, "0s": 0, "5 Min": 300_000}
    assert {k: config.duration_ms(k) for k in cases} == cases
    for bad in ("ten", "", "5 parsecs", -1, None, "s", True):
        with pytest.raises(ValueError):
            config.duration_ms(bad)
    (tmp_path / "c.json").write_text('{"kafka": {"servers": "${HOST}:9092", "retries": 3}, "out": {"servers": "${kafka.servers}", "n": "${kafka.retries}", "name": "x-${kafka.retries}", "none": "${?nowhere.at}"}}')
    assert config.load(str(tmp_path / "c.json"), env={"HOST": "h"})["out"] == {"servers": "h:9092", "n": 3, "name": "x-3", "none": ""}
    (tmp_path / "d.json").write_text('{"a": "${b}", "b": "${a}"}')
    with pytest.raises(ValueError, match="itself"):
        config.load(str(tmp_path / "d.json"), env={})


def test_jvm_metrics(spark):
    from millrace.runtime.reporting import jvm_report

    report = {n: v for n, v, _ in jvm_report(spark)}
    assert report["jvm.heap.used_bytes"] > 0 and report["jvm.threads"] > 1 and report["jvm.gc.count"] >= 0
    assert "jvm_heap_used_bytes" in exposition(jvm_report(spark))
