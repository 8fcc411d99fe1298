"""What lives between batches: last steps, deadlines, commits, sinks, windows and families."""

import json
import os
import subprocess
import sys
import threading
import time

import pytest
from millrace.plans import known
from millrace.plans import schemas as S
from millrace.sources import broker, leases, sinks, writer
from millrace.streaming import gate, runner
from millrace.streaming.windows import timed_windows_stream
from pyspark.sql import functions as F

from file_broker import FileBroker

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def wait_for(ready, seconds=90):
    for _ in range(10 * seconds):
        if ready():
            return True
        time.sleep(0.1)
    return ready()


def test_gate_keeps_order_and_gives_up_after_a_failure(spark, tmp_path):
    done, folder = [], str(tmp_path / "g")
    slow = lambda n, content: (time.sleep(0.02 * (5 - n)), done.append((n, content["k"])))
    g = gate.CommitGate(spark, folder, slow, eager=2)
    for k in range(5):
        g.submit(k, {"k": k * 10})
        assert len(g.pending) <= 4
    g.drain()
    assert done == [(k, 10 * k) for k in range(5)] and g.seen(4) and not g.seen(5)

    def failing(n, content):
        if n == 6:
            raise ZeroDivisionError
        done.append((n, content))

    g = gate.CommitGate(spark, folder, failing, eager=3)
    assert g.seen(3) and g.pending == {}
    g.submit(5, {})
    g.submit(6, {})
    with pytest.raises((gate.Abandoned, ZeroDivisionError)):
        for k in range(7, 30):
            g.submit(k, {})
            time.sleep(0.05)
    with pytest.raises((gate.Abandoned, ZeroDivisionError)):
        g.drain()
    with pytest.raises(gate.Abandoned):
        g.submit(40, {})
    assert done[-1] == (5, {})
    # a new gate begins with what failed
    again = gate.CommitGate(spark, folder, lambda n, c: done.append((n, "again")))
    left = sorted(again.pending)
    assert left[0] == 6 and again.recover() == left and done[-len(left) :] == [(n, "again") for n in left] and again.pending == {}
    few = gate.CommitGate(spark, str(tmp_path / "few"), lambda n, c: None, keep=3)
    for k in range(10):
        few.submit(k, {})
    few.drain()
    assert sorted(f for f in os.listdir(tmp_path / "few") if f.endswith(".done")) == ["7.done", "8.done", "9.done"]


KILLED = """
import os, sys
sys.path[:0] = [{root!r}]
from pyspark.sql import SparkSession
from millrace.streaming import gate, runner
die = int(sys.argv[1])
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
def step(n, content):
    if n == die:
        os.kill(os.getppid(), 0)
        os._exit(9)
    with open({log!r}, "a") as f:
        f.write(f"{{n}} {{content['rows']}}\\n")
g = gate.CommitGate(spark, {folder!r}, step, eager=3)
source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet({src!r})
s = runner.run(source, lambda b, n: {{"rows": sorted(r.id for r in b.collect())}}, {checkpoint!r}, available_now=True, gate=g)
s.query.awaitTermination(120)
s.stop()
"""


def test_a_driver_that_dies_between_steps_loses_none(spark, tmp_path):
    src, log = tmp_path / "in", tmp_path / "log"
    src.mkdir()
    for k in range(4):
        spark.range(10 * k, 10 * k + 3).coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(0.05)
    (tmp_path / "run.py").write_text(KILLED.format(root=ROOT, log=str(log), folder=str(tmp_path / "gate"), src=str(src), checkpoint=str(tmp_path / "c")))
    codes = [subprocess.run([sys.executable, str(tmp_path / "run.py"), die], timeout=180, capture_output=True).returncode for die in ("1", "2", "-1")]
    assert codes == [9, 9, 0]
    steps = [line.split(" ", 1) for line in log.read_text().splitlines()]
    # a batch of which not even the offsets were written may come again with more rows, under the same id
    numbers = [int(n) for n, _ in steps]
    assert numbers == sorted(set(numbers)) and numbers[:2] == [0, 1]
    assert sorted(x for _, rows in steps for x in json.loads(rows)) == [10 * k + j for k in range(4) for j in range(3)]


def test_keeper_extends_until_released():
    now, extended = [0.0], []
    k = leases.Keeper(lambda *own: extended.append((now[0], *own)), 20.0, 0.25, clock=lambda: now[0])
    k._thread = threading.current_thread()  # turns are taken here
    k.hold([("a", 0, 5), ("a", 5, 9), ("b", 0, 3)])
    for now[0] in range(0, 61):
        k.turn()
        if now[0] == 20:
            k.release({"a": 5})
    assert [x for x in extended if x[1:] == ("a", 0, 5)] == [(15, "a", 0, 5)]
    assert [x[0] for x in extended if x[1:] == ("a", 5, 9)] == [x[0] for x in extended if x[1] == "b"] == [15, 30, 45, 60]
    k.release({"a": 9, "b": 3})
    for now[0] in range(61, 100):
        k.turn()
    assert len(extended) == 9 and not k._heap

    def broken(*own):
        extended.append(own)
        raise OSError

    b = leases.Keeper(broken, 20.0, 0.25, clock=lambda: now[0])
    b._thread = threading.current_thread()
    b.hold([("c", 0, 1)])
    for now[0] in range(99, 140):
        b.turn()
    assert len([x for x in extended if x[0] == "c"]) >= 5  # tried again


class LeasedBroker(FileBroker):
    """Delivers a shard's records again if their deadline passes before they are committed."""

    def _note(self, what, *values):
        with open(f"{self.folder}/notes.txt", "a") as f:
            f.write(json.dumps([what, time.time(), *values]) + "\n")

    def notes(self):
        path = f"{self.folder}/notes.txt"
        return [json.loads(x) for x in open(path)] if os.path.exists(path) else []

    def read(self, shard, start, end):
        self._note("read", shard, start, end)
        yield from super().read(shard, start, end)

    def extend(self, shard, start, end):
        self._note("extend", shard, start, end)

    def committed(self, offsets):
        self._note("commit", offsets)


def leased(options):
    return LeasedBroker(options["folder"])


def test_deadlines_are_held_while_a_batch_is_processed(spark, tmp_path):
    (tmp_path / "b").mkdir()
    b = LeasedBroker(str(tmp_path / "b"))
    b.put("s", b"x")
    spark.dataSource.register(broker.ShardedSource)
    source = spark.readStream.format("sharded").options(client="test_live:leased", folder=b.folder, deadlineSeconds="2").load()
    got = []
    stream = runner.run(source, lambda df, n: (got.append(df.count()), time.sleep(6)), str(tmp_path / "c"))
    try:
        assert wait_for(lambda: got)
        b.put("s", b"y")  # Spark tells a source of a commit when it plans the batch after
        assert wait_for(lambda: any(n[0] == "commit" for n in b.notes()))
    finally:
        stream.stop(30)
    notes = b.notes()
    committed = next(n[1] for n in notes if n[0] == "commit")
    held = [next(n[1] for n in notes if n[0] == "read"), *(n[1] for n in notes if n[0] == "extend" and n[1] < committed), committed]
    # never as long as the deadline without an extension
    assert len(held) >= 5 and all(y - x < 2 for x, y in zip(held, held[1:])) and got[0] == 1


def test_commits_merge_and_are_flushed(spark, tmp_path):
    out = []
    d = leases.Debounced(out.append, 0.4)
    for k in range(10):
        d.add({"a": k, "b": 20 - k})
    assert out == [] and wait_for(lambda: out == [{"a": 9, "b": 20}], 5)
    d.add({"a": 12})
    d.flush()
    d.flush()
    assert out[1:] == [{"a": 12}] and d.pending == {}
    leases.Debounced(out.append, 0).add({"c": 1})
    assert out[2:] == [{"c": 1}]

    def broken(offsets):
        raise OSError("no")

    b = leases.Debounced(broken, 0.05)
    b.add({"a": 1})
    assert wait_for(lambda: b._error is not None, 5)
    with pytest.raises(OSError):
        b.add({"a": 2})
    assert b.pending == {"a": 1}
    # a stream of several batches commits once, and what is pending when it stops
    (tmp_path / "b").mkdir()
    spark.dataSource.register(broker.ShardedSource)
    f = LeasedBroker(str(tmp_path / "b"))
    for k in range(4):
        f.put("s", str(k).encode())
    source = spark.readStream.format("sharded").options(client="test_live:leased", folder=f.folder, maxRecordsPerShard="1", commitDebounceSeconds="600").load()
    got = []
    stream = runner.run(source, lambda df, n: got.append(df.count()), str(tmp_path / "c"))
    assert wait_for(lambda: sum(got) == 4)
    time.sleep(1)
    assert not [n for n in f.notes() if n[0] == "commit"]
    stream.stop(30)
    # Spark may kill the source's process as it stops; what Spark has committed is then told when the stream starts again
    f.put("s", b"more")
    again = runner.run(source, lambda df, n: got.append(df.count()), str(tmp_path / "c"))
    assert wait_for(lambda: sum(got) == 5)
    reader = broker._Reader({"client": "test_live:leased", "folder": f.folder, "commitdebounceseconds": "600"})
    reader.partitions({"s": 4}, {"s": 5})
    assert reader._commits.pending == {"s": 4}
    reader.stop()
    again.stop(30)
    commits = [n[2] for n in f.notes() if n[0] == "commit"]
    assert {"s": 4} in commits and len(commits) <= 3


class FolderClient:
    """Keeps each request as lines of a file; a request with a value that is to fail does so once."""

    def __init__(self, options):
        self.folder = options["folder"]

    def put(self, records):
        for r in records:
            if r.value == b"poison" and not os.path.exists(f"{self.folder}/poisoned"):
                open(f"{self.folder}/poisoned", "w").close()
                raise RuntimeError("poison")
        with open(f"{self.folder}/{time.time_ns()}-{os.getpid()}.sent", "w") as f:
            f.writelines(f"{r.value.decode()}\n" for r in records)
        return [None] * len(records)


def sent(folder):
    return sorted(x for f in os.listdir(folder) if f.endswith(".sent") for x in open(f"{folder}/{f}").read().split())


def test_batches_and_streams_are_written_by_tasks(spark, tmp_path):
    spark.dataSource.register(writer.RecordSink)
    out, log, src = tmp_path / "out", tmp_path / "log", tmp_path / "in"
    out.mkdir()
    src.mkdir()
    options = {"client": "test_live:FolderClient", "folder": str(out), "limits": "kinesis"}
    df = spark.range(20).repartition(4).select(*sinks.sinkable(F.col("id").cast("string")))
    df.write.format("records").mode("append").options(**options).save()
    assert sent(out) == sorted(map(str, range(20)))
    with pytest.raises(Exception, match="value"):
        spark.range(3).write.format("records").mode("append").options(**options).save()

    def stream(checkpoint):
        s = spark.readStream.schema("value binary").option("maxFilesPerTrigger", 1).parquet(str(src))
        return s.writeStream.format("records").options(**options, log=str(log)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()

    for k in range(3):
        spark.createDataFrame([(bytearray(f"s{k}{j}".encode()),) for j in range(2)], "value binary").coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(0.05)
    assert stream(tmp_path / "c").awaitTermination(90)
    assert [json.loads((log / f"{k}.json").read_text())["records"] for k in range(3)] == [2, 2, 2]
    before = sent(out)
    assert before == sorted([*map(str, range(20)), *(f"s{k}{j}" for k in range(3) for j in range(2))])
    # an epoch that is delivered again, as Spark's own log of it was lost, is not sent again
    assert stream(tmp_path / "c2").awaitTermination(90)
    assert sent(out) == before
    # a task that fails fails the epoch, which has no entry and is sent when it comes again
    spark.createDataFrame([(bytearray(b"poison"),)], "value binary").coalesce(1).write.mode("append").parquet(str(src))
    with pytest.raises(Exception, match="poison"):
        stream(tmp_path / "c").awaitTermination(90)
    assert not (log / "3.json").exists()
    assert stream(tmp_path / "c").awaitTermination(90)
    assert sent(out) == sorted([*before, "poison"]) and (log / "3.json").exists()


def test_posts_go_out_in_parallel():
    client, at_once, most = sinks.HttpClient("http://none", 4), [0], []

    def post(record):
        at_once[0] += 1
        most.append(at_once[0])
        time.sleep(0.05)
        at_once[0] -= 1
        return None if record.value != b"2" else "500 no"

    client._post = post
    assert client.put([sinks.Record(str(k).encode()) for k in range(8)]) == [None, None, "500 no", None, None, None, None, None] and max(most) > 1


def test_windows_of_a_live_stream_grow(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = []
    source = spark.readStream.format("rate").option("rowsPerSecond", 20).load().selectExpr("'k' AS key", "value AS `order`", "1L AS weight", "CAST(NULL AS string) AS boundary")
    query = timed_windows_stream(source, 4000, 0.25).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    try:
        assert wait_for(lambda: len(out) >= 4)
    finally:
        query.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    first = out[:4]
    assert [(r.window_no, r.length_ms, r.reason) for r in first] == [(0, 1000, "end"), (1, 2000, "end"), (2, 4000, "end"), (3, 4000, "end")]
    assert all(a.opened_ms + a.length_ms <= b.opened_ms for a, b in zip(first, first[1:])) and all(r.n > 0 and r.weight == r.n for r in first)


def test_known_families_are_resolved_once():
    now, asked = [0.0], []

    class Counting(S.Registry):
        def up_to(self, family, version):
            asked.append((family.name, version))
            return super().up_to(family, version)

    schema = {"type": "object", "properties": {"k": {"type": "integer"}}}
    registry = Counting({("acme", n, 1, 0, a): schema for n in ("one", "two") for a in range(2)})
    one, two, lost = (S.Family("contexts", "acme", n, 1) for n in ("one", "two", "lost"))
    k = known.KnownFamilies(registry, expiry=100, retry=10, clock=lambda: now[0])
    first = k.resolved({one: [(0, 0)], lost: [(0, 0)]})
    assert [c.family for c in first.columns] == [one] and [f.family for f in first.failures] == [lost] and len(asked) == 2
    # the same families, or fewer: no call, the same columns
    assert k.resolved({one: [(0, 0)]}) == k.resolved({}) == first and len(asked) == 2
    second = k.resolved({one: [(0, 1)], two: [(0, 0)]})
    assert [c.family for c in second.columns] == [one, two] and second.columns[0].versions == {(0, 0), (0, 1)} and len(asked) == 4
    now[0] = 11  # a failure is tried again, what is resolved is not
    registry.schemas[("acme", "lost", 1, 0, 0)] = schema
    third = k.resolved({})
    assert [c.family for c in third.columns] == [lost, one, two] and third.failures == () and len(asked) == 5
    now[0] = 105
    k.resolved({})
    assert len(asked) == 7 and k.lookups == 7
    assert third == S.resolve({one: [(0, 0), (0, 1)], two: [(0, 0)], lost: [(0, 0)]}, registry)
    clash = known.KnownFamilies(S.Registry({("a.b", "c", 1, 0, 0): schema, ("a_b", "c", 1, 0, 0): schema}))
    with pytest.raises(S.ClashingColumnNames):
        clash.resolved({S.Family("contexts", v, "c", 1): [(0, 0)] for v in ("a.b", "a_b")})
