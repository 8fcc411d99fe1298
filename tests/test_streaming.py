import random
import time
import urllib.error
import urllib.request

import pytest
from millrace.operators.codec import Limits
from millrace.sources import broker, http, leases, limits, registry, sinks
from millrace.streaming import runner
from millrace.streaming.batching import batch_up_stream
from millrace.streaming.health import SourceState
from pyspark.sql import functions as F

from file_broker import FileBroker


class Clock:
    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        return self.now


def test_source_health():
    clock = Clock()
    s = SourceState(clock)
    assert s.unhealthy(10) is None and s.latency() is None
    clock.now += 10
    assert s.unhealthy(10) is None
    clock.now += 0.1
    assert "source" in s.unhealthy(10)
    s.heard()
    assert s.unhealthy(10) is None
    s.received()
    assert s.latency() == 0
    s.observed(clock.now - 3)
    clock.now += 11
    s.heard()
    assert "processor" in s.unhealthy(10) and s.latency() == pytest.approx(14)
    s.finished()
    assert s.unhealthy(10) is None and s.latency() is None
    s.connected = False
    assert "connection" in s.unhealthy(10)


def test_runner_commits_after_success_and_replays_after_failure(spark, tmp_path):
    spool, checkpoint = str(tmp_path / "spool"), str(tmp_path / "checkpoint")
    server = http.serve(spool)
    base = f"http://127.0.0.1:{server.server_port}"
    assert urllib.request.urlopen(base + "/").status == 200
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(urllib.request.Request(base + "/input", b"x", {"Content-Type": "text/plain"}))
    assert e.value.code == 415
    with pytest.raises(urllib.error.HTTPError) as e:  # without a length, as a chunked post
        urllib.request.urlopen(urllib.request.Request(base + "/input", iter([b"a", b"b"]), {"Content-Type": "application/octet-stream"}, method="POST"))
    assert e.value.code == 411
    out = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"two"),)], "v binary").select(*sinks.sinkable(F.col("v")))
    address = limits.HttpSink(base + "/").address()
    sinks.write(out, lambda: sinks.HttpClient(address), limits.RequestLimits(10, 1000), attempts=2)
    server.shutdown()

    seen: list[list[bytes]] = []

    def fail(batch, batch_id):
        seen.append(sorted(bytes(r.value) for r in batch.collect()))
        raise RuntimeError("no")

    stream = runner.run(http.read_stream(spark, spool), fail, checkpoint, "source_ts", available_now=True)
    with pytest.raises(Exception, match="no"):
        stream.query.awaitTermination(60)
    assert stream.unhealthy(60) == "no connection to the source"
    good = runner.run(http.read_stream(spark, spool), lambda b, i: seen.append(sorted(bytes(r.value) for r in b.collect())), checkpoint, "source_ts", available_now=True)
    assert good.query.awaitTermination(60)
    assert seen == [[b"one", b"two"]] * 2
    again = runner.run(http.read_stream(spark, spool), lambda b, i: seen.append(["more"]), checkpoint, available_now=True)
    assert again.query.awaitTermination(60) and len(seen) == 2
    again.stop()


def test_decompressing_processor(spark):
    got = []
    one = runner.decompressing(lambda df, i: got.append((i, df.count())), Limits(100, 100))
    one(spark.createDataFrame([(bytearray(b"plain"),), (bytearray(b"\x1f\x8bjunk"),)], "value binary"), 3)
    assert got == [(3, 2)]


def test_sharded_source(spark, tmp_path, monkeypatch):
    folder, checkpoint = str(tmp_path / "broker"), str(tmp_path / "checkpoint")
    (tmp_path / "broker").mkdir()
    b = FileBroker(folder)
    for k in range(25):
        b.put(f"s{k % 2}", f"v{k}".encode(), f"k{k}", 1000 * k)
    config = {"client": "file_broker:file_broker", "folder": folder, "maxRecordsPerShard": "5"}
    got = []

    def start(available=True):
        return runner.run(registry.open_source(spark, config), lambda df, i: got.append([tuple(r) for r in df.select("shard", "offset", "value").collect()]), checkpoint, "source_ts")

    for n in (25, 27):
        stream = start()
        for _ in range(900):
            if sum(map(len, got)) >= n:
                break
            time.sleep(0.1)
        stream.stop(30)
        b.put("s0", b"w1")
        b.put("s2", b"w2")
    rows = [r for batch in got for r in batch]
    assert len(rows) == len(set(rows)) == 27 and all(len(x) <= 15 for x in got)
    reader = broker._Reader({"client": config["client"], "folder": folder, "initialposition": "AT_TIMESTAMP", "timestamp": "20000"})
    assert reader.initialOffset()["s0"] == 10
    with pytest.raises(ValueError):
        registry.open_source(spark, {"kinesis": {}})
    # several tasks a shard, and commits that are tried again
    ranges = broker._Reader({"client": config["client"], "folder": folder, "parallelpullfactor": "0.01"}).partitions({"s0": 2}, {"s0": 9})
    assert [(r.start, r.end) for r in ranges] == [(2, 9)]
    ranges = broker._Reader({"client": config["client"], "folder": folder, "parallelpullfactor": "100"}).partitions({"s0": 2}, {"s0": 9})
    assert [(r.start, r.end) for r in ranges] == [(k, k + 1) for k in range(2, 9)]
    tries = []

    class Busy(FileBroker):
        def committed(self, offsets):
            tries.append(offsets)
            if len(tries) < 3:
                raise leases.Throttled

    monkeypatch.setattr(broker, "client_of", lambda options: Busy(folder))
    broker._Reader({"client": "", "commitdelayseconds": "0.001"}).commit({"s0": 5})
    assert tries == [{"s0": 5}] * 3


def test_kafka_records_and_options(spark):
    df = spark.createDataFrame([(bytearray(b"x"), None), (bytearray(b"y"), "k")], "v binary, k string").select(*sinks.sinkable(F.col("v"), F.col("k"), F.create_map(F.lit("h"), F.lit("é"))))
    rows = {bytes(r.value): r for r in sinks.for_kafka(df).collect()}
    assert rows[b"y"].key == "k" and len(rows[b"x"].key) == 36 and bytes(rows[b"x"].headers[0].value) == "é".encode()
    assert limits.KafkaSource("h:1", "t", (("group.id", "g"),)).options()["kafka.group.id"] == "g"
    assert limits.KafkaSource("h:1", "t").options() == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "latest"}


class Flaky:
    def __init__(self, seed=1):
        self.rng, self.got, self.calls = random.Random(seed), [], []

    def put(self, records):
        self.calls.append(len(records))
        out = [None if self.rng.random() < 0.6 else "Throttled" for _ in records]
        self.got += [r.value for r, e in zip(records, out) if e is None]
        return out


def test_requests_and_retries():
    records = [sinks.Record(bytes(n), "k" * 3) for n in (10, 20, 30, 200, 1, 1, 1)]
    sizes = [[len(r.value) for r in q] for q in sinks.requests(records, limits.RequestLimits(3, 60, counts_key=True))]
    assert sizes == [[10, 20], [30], [200], [1, 1, 1]]
    slept = []
    client = Flaky()
    unique = [sinks.Record(str(k).encode()) for k in range(40)]
    assert sinks.send(client, unique, limits.RequestLimits(16, 10**6), 1.0, 5.0, sleep=slept.append) == 40
    assert sorted(client.got) == sorted(r.value for r in unique) and set(slept) <= {1.0, 2.0, 3.0, 5.0}

    class Never:
        def put(self, records):
            return ["no"] * len(records)

    with pytest.raises(OSError, match="2 records failed: no"):
        sinks.send(Never(), unique[:2], limits.NSQ, attempts=3, sleep=slept.append)
    with pytest.raises(sinks.RecordTooLarge):
        sinks.send(Never(), [sinks.Record(bytes(1_000_001))], limits.KINESIS, sleep=slept.append)
    whole = Flaky(3)
    sinks.send(whole, unique[:5], limits.RequestLimits(5, 10**6), only_failed=False, sleep=slept.append)
    assert set(whole.calls) == {5}


def test_names_positions_and_broker_health():
    assert limits.resource_name("topics", "projects/p/topics/t") == ("p", "t")
    for bad in ("projects/p/t", "projects/p/subscriptions/t", "projects//topics/t"):
        with pytest.raises(ValueError):
            limits.resource_name("topics", bad)
    assert limits.initial_position("TrimHorizon") == limits.initial_position("TRIM_HORIZON") == ("earliest", None)
    for bad in (("AT_TIMESTAMP", None), ("LATEST", 5), ("soon", None)):
        with pytest.raises(ValueError):
            limits.initial_position(*bad)
    assert sinks.partitions_healthy([1, 2]) and not sinks.partitions_healthy([]) and not sinks.partitions_healthy([1, None])
    assert sinks.any_open([[False], [False, True]]) and not sinks.any_open([])


def test_stateful_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "in"
    src.mkdir()
    out = []
    schema = "key string, order long, item string, weight long"
    rows = [("k", n, "abcdefg"[n], w) for n, w in enumerate([1, 2, 3, 2, 5, 1, 10])]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = batch_up_stream(stream, 5, 2000).writeStream.foreachBatch(lambda df, i: out.extend(df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(900):
            if len(out) >= 5:
                break
            time.sleep(0.1)
        assert [("".join(r["items"]), r.weight) for r in out] == [("ab", 3), ("cd", 5), ("e", 5), ("f", 1), ("g", 10)]
        spark.createDataFrame([("k", 0, "h", 1)], schema).coalesce(1).write.mode("append").parquet(str(src))
        for _ in range(900):
            if len(out) >= 6:
                break
            time.sleep(0.1)
        assert ("".join(out[5]["items"]), out[5].reason) == ("h", "delay")
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_deadlines_and_commits():
    from millrace.sources import leases

    assert leases.parallel_pulls(0.5, 3) == 2 and leases.parallel_pulls(0.1, 1) == 1
    tries = []

    def busy():
        tries.append(1)
        if len(tries) < 3:
            raise leases.Throttled

    assert leases.commit(busy, 1, 5, lambda s: None) and len(tries) == 3

    def lost():
        raise leases.LeaseLost

    assert not leases.commit(lost, 1, 5, lambda s: None)
    with pytest.raises(ZeroDivisionError):
        leases.commit(lambda: 1 / 0, 1, 5, lambda s: None)


def test_listener_reports_progress(spark, tmp_path):
    from millrace.streaming.listener import ProgressListener

    src = tmp_path / "in"
    src.mkdir()
    spark.range(7).coalesce(1).write.mode("append").parquet(str(src))
    listener = ProgressListener(SourceState())
    spark.streams.addListener(listener)
    try:
        stream = runner.run(spark.readStream.schema("id long").parquet(str(src)), lambda b, i: b.count(), str(tmp_path / "c"), available_now=True)
        assert stream.query.awaitTermination(60)
        for _ in range(100):
            if not listener.state.connected:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert ("rows", 7, "c") in listener.metrics.report() and not listener.state.connected


def test_source_timestamps_are_observed_without_jobs_or_copies(spark, tmp_path):
    from millrace.streaming.listener import ProgressListener

    src = tmp_path / "in"
    src.mkdir()
    spark.range(7).selectExpr("id", "timestamp_seconds(1000 + id) AS ts").coalesce(1).write.mode("append").parquet(str(src))
    listener, jobs = ProgressListener(SourceState(clock=lambda: 1500.0)), []
    tracker = spark.sparkContext.statusTracker()
    spark.streams.addListener(listener)

    def processor(batch, batch_id):
        group = str(tmp_path)
        spark.sparkContext.setJobGroup(group, "one action")
        assert not batch.is_cached and batch.count() == 7
        jobs.extend(tracker.getJobIdsForGroup(group))

    try:
        stream = runner.run(spark.readStream.schema("id long, ts timestamp").parquet(str(src)), processor, str(tmp_path / "c"), "ts", available_now=True)
        assert stream.query.awaitTermination(60)
        for _ in range(100):
            if not listener.state.connected:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert ("latency_ms", 500_000, "g") in listener.metrics.report()
    assert len(jobs) <= 2  # a count is a shuffle, which adaptive execution makes two jobs of
