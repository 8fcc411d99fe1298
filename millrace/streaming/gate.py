"""Last steps of batches that may run while later batches are processed, and are not lost.

Spark commits a batch when its processor returns, so a step that is still to come must be written down before that. A
gate keeps a manifest a batch in a shared folder: what the step needs is written as ``pending`` before the batch is
committed, and ``done`` after the step. Steps run in the order of batches; the pending ones of a driver that died run first
when the stream starts again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import SparkSession

#: step(batch id, what the processor returned); it may be run again for a batch that it already ran for.
Step = Callable[[int, dict], None]


class Abandoned(RuntimeError):
    """The step of an earlier batch failed, so this one was not begun; its manifest stays pending."""


class CommitGate:
    """Runs ``step`` for each submitted batch, in order, with at most ``eager`` batches waiting.

    Once a step has failed, those after it are abandoned and the next ``submit`` raises, which ends the stream; a new
    gate on the folder begins with the failed one. ``keep`` manifests of finished batches stay, more than Spark can deliver again.
    """

    def __init__(self, spark: SparkSession, folder: str, step: Step, eager: int = 4, keep: int = 200):
        self.step, self.eager, self.keep = step, eager, keep
        jvm = spark.sparkContext._jvm
        self._path = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs.mkdirs(self._path())
        self._pool, self._waiting = ThreadPoolExecutor(1), []  # type: ignore[var-annotated]
        self._failed: BaseException | None = None
        self.pending: dict[int, dict] = {}
        self.done: set[int] = set()
        for status in self._fs.listStatus(self._path()):
            number, _, kind = status.getPath().getName().partition(".")
            if kind == "done":
                self.done.add(int(number))
            elif kind == "pending":
                self.pending[int(number)] = self._read(f"{number}.pending")
        for number in self.done & self.pending.keys():
            del self.pending[number]
            self._remove(f"{number}.pending")

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, name: str, content: dict) -> None:
        # whole under its name, or not at all
        hidden = self._path(f".{name}")
        out = self._fs.create(hidden, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        self._fs.delete(self._path(name), False)
        if not self._fs.rename(hidden, self._path(name)):
            raise OSError(f"could not write manifest {name}")

    def _remove(self, name: str) -> None:
        self._fs.delete(self._path(name), False)

    def recover(self) -> list[int]:
        """Run the steps that a driver before left pending, in order; their batches."""
        found = sorted(self.pending)
        for number in found:
            self._finish(number, self.pending[number])
        return found

    def seen(self, batch_id: int) -> bool:
        """Whether a batch has been processed before: Spark delivers the same rows again under the same id, and they need nothing more."""
        return batch_id in self.done or batch_id in self.pending

    def submit(self, batch_id: int, content: dict | None) -> None:
        """Write a batch's manifest and let its step run when its turn comes; waits while too many are pending."""
        self._raise_failed()
        self._write(f"{batch_id}.pending", content or {})
        self.pending[batch_id] = content or {}
        self._waiting.append(self._pool.submit(self._in_turn, batch_id, content or {}))
        self._settle(self.eager)

    def drain(self) -> None:
        """Wait for all steps; raises what the first that failed raised."""
        self._settle(0)
        self._raise_failed()

    def _settle(self, most: int) -> None:
        while len(self._waiting) > most or self._waiting and self._waiting[0].done():
            future: Future = self._waiting.pop(0)
            future.result()

    def _raise_failed(self) -> None:
        if self._failed is not None:
            raise Abandoned(f"an earlier batch's step failed: {self._failed}") from self._failed

    def _in_turn(self, batch_id: int, content: dict) -> None:
        self._raise_failed()
        try:
            self._finish(batch_id, content)
        except BaseException as error:
            self._failed = error
            raise

    def _finish(self, batch_id: int, content: dict) -> None:
        self.step(batch_id, content)
        self._write(f"{batch_id}.done", {})
        self.done.add(batch_id)
        self._remove(f"{batch_id}.pending")
        self.pending.pop(batch_id, None)
        for old in [n for n in self.done if n <= batch_id - self.keep]:
            self._remove(f"{old}.done")
            self.done.discard(old)
