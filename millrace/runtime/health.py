"""Health of an application and its HTTP probe."""

from __future__ import annotations

import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


class AppHealth:
    """Setup is awaited, healthy, or unhealthy with an alert; runtime services are unhealthy one by one.

    ``reporters`` are asked on every probe and return why they are unhealthy, or None.
    """

    def __init__(self, reporters: list[Callable[[], str | None]] = ()):
        self._lock = threading.Lock()
        self._setup: tuple[str, str | None] = ("awaiting", None)
        self._services: set[str] = set()
        self._reporters = list(reporters)
        self._listeners: list[Callable[[str, str | None], None]] = []

    def on_setup_change(self, listener: Callable[[str, str | None], None]) -> None:
        self._listeners.append(listener)

    def _set(self, state: tuple[str, str | None]) -> None:
        with self._lock:
            changed, self._setup = self._setup != state, state
        for listener in self._listeners if changed else ():
            listener(*state)

    def setup_healthy(self) -> None:
        self._set(("healthy", None))

    def setup_unhealthy(self, alert: str) -> None:
        self._set(("unhealthy", alert))

    def service_unhealthy(self, service: str) -> None:
        with self._lock:
            self._services.add(service)

    def service_healthy(self, service: str) -> None:
        """A service that works proves the setup."""
        with self._lock:
            self._services.discard(service)
        self.setup_healthy()

    @property
    def setup(self) -> tuple[str, str | None]:
        with self._lock:
            return self._setup

    def problems(self) -> list[str]:
        state, alert = self.setup
        out = ["external setup configuration is awaited"] if state == "awaiting" else [f"setup: {alert}"] if state == "unhealthy" else []
        with self._lock:
            out += [f"{s} is unhealthy" for s in sorted(self._services)]
        return out + [m for r in self._reporters if (m := r()) is not None]


def serve_probe(health: AppHealth, port: int, metrics: Callable[[], str] = lambda: "") -> ThreadingHTTPServer:
    """Answer 200 or 503 with the problems on any path, and metrics as text on ``/metrics``; runs until shutdown()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            problems = health.problems() if self.path != "/metrics" else []
            body = (metrics() if self.path == "/metrics" else "; ".join(problems) or "OK").encode()
            self.send_response(503 if problems else 200)
            self.send_header("Content-Type", "text/plain; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
