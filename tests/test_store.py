"""The facade: point operations, scans, persistence, compaction, log replay, statistics, messaging, handlers, options."""

import random
import time

import pytest
from pyspark.sql import functions as F

import kvloom
from kvloom import Closed, EmptyKey, HandlerTimeout, KeyNotFound, NoHandler, Options, PublishRefused, StoreError, open_store
from kvloom.functions.handlers import Handlers
from kvloom.functions.hooks import Hooks, as_read, written
from kvloom.operators import log as L
from kvloom.operators import sketches
from kvloom.operators.fold import latest
from kvloom.sources import rawlog
from kvloom.sources.wal import Wal
from kvloom.streaming.pubsub import Channels


@pytest.fixture
def store(spark, tmp_path):
    s = open_store(spark, f"{tmp_path}/db")
    yield s
    if not s._closed:
        s.close()


def test_basic(store):
    b = store.bucket("test")
    b.set(b"key1", b"value1")
    assert b.get(b"key1") == b"value1" and b.has(b"key1")
    b.delete(b"key1")
    assert not b.has(b"key1")
    with pytest.raises(KeyNotFound):
        b.get(b"key1")
    b.delete(b"never there")
    for f in (lambda: b.set(b"", b"v"), lambda: b.get(b"")):
        with pytest.raises(EmptyKey):
            f()


def test_buckets_and_scans(store):
    one, two, all_ = store.bucket("bucket1"), store.bucket("bucket2"), store.bucket("")
    one.set(b"key", b"value1")
    two.set(b"key", b"value2")
    store.bucket("a").set(b"b\0c", b"nested")
    one.set(b"empty", b"")
    assert one.get(b"key") == b"value1" and two.get(b"key") == b"value2" and one.get(b"empty") == b""
    assert sorted(one.get_all()) == [(b"empty", b""), (b"key", b"value1")]
    assert store.bucket("a\0b").get(b"c") == b"nested"
    assert {k for k, _ in all_.get_all()} == {b"bucket1\0key", b"bucket2\0key", b"a\0b\0c", b"bucket1\0empty"}
    seen = []
    all_.scan(lambda k, v: seen.append(k) or len(seen) < 2)
    assert len(seen) == 2


def test_persist_compact_and_close(spark, tmp_path):
    path = f"{tmp_path}/db"
    s = open_store(spark, path, Options().with_compaction(10, 0.1, 60))
    b = s.bucket("t")
    b.batch_set([(b"k%d" % i, b"v%d" % i) for i in range(100)])
    b.batch_set([(b"dup", b"1"), (b"dup", b"2")])
    for i in range(50):
        b.delete(b"k%d" % i)
    before = s.size()
    assert s.compact_if_needed() and s.size() < before
    assert not b.has(b"k0") and b.get(b"k99") == b"v99" and b.get(b"dup") == b"2"
    b.set(b"late", b"x")
    s.close()
    for f in (lambda: b.set(b"k", b"v"), s.close, s.size):
        with pytest.raises(Closed):
            f()
    again = open_store(spark, path)
    assert again.bucket("t").get(b"late") == b"x" and again.stats()["num_keys"] == 52
    again.bucket("t").set(b"late", b"y")
    assert again.bucket("t").get(b"late") == b"y"
    again.close()
    with pytest.raises(StoreError):
        open_store(spark, f"{tmp_path}/no/such/db")


def test_log_replay_after_crash(spark, tmp_path):
    path = f"{tmp_path}/db"
    s = open_store(spark, path, Options().with_wal_disabled(False))
    s.bucket("t").set(b"a", b"1")
    s.bucket("t").set(b"b", b"2")
    s.bucket("t").delete(b"a")
    del s  # without close or flush
    again = open_store(spark, path)
    assert again.bucket("t").get_all() == [(b"b", b"2")]
    again.close()


def test_wal(spark, tmp_path):
    w = Wal(spark, f"{tmp_path}/wal")
    assert w.size() == 0
    rows = [(i, "t", b"k%d" % i, b"t\0k%d" % i, "put", b"v") for i in range(10)]
    w.append(spark.createDataFrame([(s, b, bytearray(u), bytearray(f), o, bytearray(v)) for s, b, u, f, o, v in rows], L.KVLOG))
    assert [bytes(r["user_key"]) for r in w.read_next()] == [r[2] for r in rows]
    assert w.size() == 10 * (8 + 4 + 1) and w.file_size() > 0
    assert bytes(w.read(13).first()["user_key"]) == b"k1" and w.between(0, 26).count() == 2
    w.close()
    with pytest.raises(Closed):
        w.append(w.records())


def test_random_log_against_a_dict(spark):
    r = random.Random(5)
    rows, model = [], {}
    for seq in range(1, 1500):
        key, op = b"k%d" % r.randrange(60), r.choice(["put", "put", "del"])
        value = b"%d" % seq if op == "put" else None
        rows.append((seq, "b", bytearray(key), bytearray(b"b\0" + key), op, value and bytearray(value)))
        model.update({key: value})
    r.shuffle(rows)
    got = {bytes(x["user_key"]): bytes(x["value"]) for x in latest(spark.createDataFrame(rows, L.KVLOG)).collect()}
    assert got == {k: v for k, v in model.items() if v is not None}


def test_bulk_append_and_statistics(spark, store):
    df = spark.range(1000).select(F.lit("b").alias("bucket"), F.encode(F.concat(F.lit("key"), F.col("id").cast("string")), "utf-8").alias("user_key"), F.lit("put").alias("op"), F.lit(b"v").alias("value"), F.col("id").alias("position"))
    store.append(df)
    stats = store.stats()
    assert stats["num_keys"] == 1000 and 900 <= stats["estimated_keys"] <= 1100 and stats["bloom_insertions"] == 2000
    assert {"file_size_bytes", "logical_offset", "bloom_fpr", "cache_size"} <= set(stats)
    for _ in range(5):
        store.bucket("b").set(b"hot", b"v")
    assert store.bucket("b").key_frequency(b"hot") == 5 and store.bucket("b").keys_in_bucket() == 1001
    assert store.healthy()


def test_sketch_bounds(spark):
    keys = spark.range(500).select(F.encode(F.concat(F.lit("key"), F.col("id").cast("string")), "utf-8").alias("full_key"))
    others = spark.range(10_000, 20_000).select(F.encode(F.concat(F.lit("key"), F.col("id").cast("string")), "utf-8").alias("full_key"))
    bits = sketches.bloom_bits(keys, 1000, 0.01)
    assert sketches.bloom_test(keys, bits, 1000, 0.01).filter("NOT maybe").count() == 0
    assert sketches.bloom_test(others, bits, 1000, 0.01).filter("maybe").count() <= 500
    one = keys.filter("full_key = encode('key7', 'utf-8')")
    many = spark.range(5000).crossJoin(one).select("full_key")
    assert abs(sketches.cms_estimate(one, sketches.cms(many)).first()["estimate"] - 5000) <= 250
    assert sketches.bloom_size(1_000_000, 0.01) == (9585059, 7) and sketches.cms_width(0.01) == 512 and sketches.cms_depth(0.99) == 1


def test_raw_layout(spark, tmp_path):
    data = b"".join([rawlog.encode(b"t\0a", b"x" * 100, 10), rawlog.encode(b"t\0b", b"y"), rawlog.encode(b"t\0b", None)])
    (tmp_path / "log.db").write_bytes(data + bytes(64))
    rows = list(rawlog.decode(data + b"\0\0\0\5ab"))
    assert [r[1:] for r in rows] == [(b"t\0a", "put", b"x" * 100), (b"t\0b", "put", b"y"), (b"t\0b", "del", None)]
    log = rawlog.as_log(rawlog.read_raw(spark, str(tmp_path / "log.db")))
    assert [(r["bucket"], bytes(r["user_key"])) for r in latest(log).collect()] == [("t", b"a")]
    with pytest.raises(ValueError):
        rawlog.encode(b"", b"v")


def test_offsets_of_many_ranges(spark):
    place = lambda i: i * 50_000_021 - 3 * 10**9  # noqa: E731  many blocks, several groups of them, below and above 0
    df = spark.range(1000).select((F.col("id") * 50_000_021 - 3 * 10**9).alias("seq"), (F.col("id") % 7 + 1).cast("long").alias("n"))
    total, want = 0, {}
    for i in range(1000):
        want[place(i)] = total
        total += i % 7 + 1
    assert {r["seq"]: r["at"] for r in L.running_start(df, "seq", "n", "at").collect()} == want
    assert L.shard_count(0) == 64 and L.shard_count(60) == 64 and L.shard_count(65) == 128


def test_channels():
    c, got = Channels(), []
    n1, undo = c.subscribe("", "ch", got.append)
    c.subscribe("b1", "ch", lambda p: got.append(b"b1:" + p))
    c.subscribe("", "ch", lambda p: 1 / 0)
    assert n1 == 1 and c.publish("", "ch", b"x") == 2 and got == [b"x"]
    assert c.publish("b1", "ch", b"y") == 1 and got[-1] == b"b1:y" and c.ids("", "ch") == [1, 3]
    undo()
    undo()
    assert c.count("", "ch") == 1
    c.unsubscribe_all("", "ch")
    assert c.publish("", "ch", b"x") == 0


def test_store_channels_are_apart(store):
    got = []
    store.subscribe("ch", lambda p: got.append(("db", p)))
    store.bucket("").subscribe("ch", lambda p: got.append(("empty", p)))
    store.bucket("b").subscribe("ch", lambda p: got.append(("b", p)))
    assert store.publish("ch", b"1") == 1 and store.bucket("").publish("ch", b"2") == 1 and store.bucket("b").publish("ch", b"3") == 1
    assert store.channels.drain(5) and sorted(got, key=lambda x: x[1]) == [("db", b"1"), ("empty", b"2"), ("b", b"3")]


def test_handlers(store):
    h = Handlers(0.1)
    h.register("up", lambda p: p.upper())
    h.register("slow", lambda p: time.sleep(0.4))
    h.register("bad", lambda p: 1 / 0)
    assert h.call("up", b"a") == b"A" and h.call_direct("up", b"a") == b"A" and h.names() == ["bad", "slow", "up"]
    with pytest.raises(HandlerTimeout, match='call to "slow" timed out'):
        h.call("slow", b"")
    with pytest.raises(ZeroDivisionError):
        h.call("bad", b"")
    with pytest.raises(NoHandler, match='no handler registered for "none"'):
        h.call("none", b"")
    store.bucket("b").register_handler("f", lambda p: p + b"!")
    assert store.bucket("b").call("f", b"x") == b"x!"
    with pytest.raises(NoHandler):
        store.call("f", b"x")


def test_hooks(spark):
    log = spark.createDataFrame([(1, "b", bytearray(b"k"), bytearray(b"b\0k"), "put", bytearray(b"v")), (2, "b", bytearray(b"k"), bytearray(b"b\0k"), "del", None)], L.KVLOG)
    out = written(log, Hooks(on_write=lambda v: F.concat(v, F.lit(b"!")), on_delete=lambda k: F.lit(True)))
    assert [bytes(r["value"]) for r in out.collect()] == [b"v!"]
    assert bytes(as_read(latest(out), Hooks(on_read=lambda v: F.concat(F.lit(b"r"), v))).first()["value"]) == b"rv!"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_flush_keeps_rows_when_the_write_fails(store, monkeypatch):
    b = store.bucket("t")
    b.set(b"k", b"v")
    with monkeypatch.context() as m:
        m.setattr(type(store), "_write", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.flush()
    assert b.get(b"k") == b"v"
    store.flush()
    assert store._buffer == [] and b.get(b"k") == b"v" and store.stats()["num_keys"] == 1


def test_bulk_append_logs_every_record(spark, store):
    store.bucket("b").set(b"first", b"0")
    rows = [("b", bytearray(b"k%d" % (i % 10)), "put" if i % 10 != 3 or i < 90 else "del", bytearray(b"%d" % i), i - 50) for i in range(100)]
    store.append(spark.createDataFrame(rows, "bucket string, user_key binary, op string, value binary, position long").repartition(5))
    assert store.bucket("b").key_frequency(b"k1") == 10 and store.log().select("seq").distinct().count() == 101
    assert store.bucket("b").get(b"k1") == b"91" and not store.bucket("b").has(b"k3")
    store.bucket("b").set(b"k1", b"later")
    store.flush()
    assert store.bucket("b").get(b"k1") == b"later"
    offsets = L.running_start(store.log().withColumn("n", L.record_length()), "seq", "n", "at").select("at").distinct().count()
    assert offsets == store.log().count()
    with pytest.raises(EmptyKey):
        store.append(spark.createDataFrame([("b", bytearray(b""), "put", bytearray(b"v"), 1)], "bucket string, user_key binary, op string, value binary, position long"))


def test_reads_go_to_one_part(store):
    names = ["a", "a\0b", "c", "", "größe"]
    for n in names:
        store.bucket(n).batch_set([(b"k%d" % i, n.encode()) for i in range(5)])
    store.flush()
    for n in names:
        assert store.bucket(n).get(b"k1") == n.encode()
    assert len(store.bucket("a").get_all()) == 10 and len(store.bucket("a\0b").get_all()) == 5 and len(store.bucket("").get_all()) == 25
    scan = plan(store.bucket("c").frame())
    assert "PartitionFilters: [isnotnull(part" in scan and f"= {L.part_of(bytes('c', 'ascii') + bytes(1))})" in scan
    one = plan(store._durable(b"c\0k1").filter(F.col("full_key") == F.lit(b"c\0k1")))
    assert "PushedFilters: [" in one and "EqualTo(full_key" in one
    for line in (plan(latest(store.log())), plan(L.running_start(store.log().withColumn("n", L.record_length()), "seq", "n", "at"))):
        assert "SortAggregate" not in line


def test_cache_of_values(spark, tmp_path):
    s = open_store(spark, f"{tmp_path}/db", Options().with_cache_size(2))
    b = s.bucket("t")
    b.batch_set([(b"%d" % i, b"v") for i in range(4)])
    s.flush()
    for i in range(4):
        assert b.get(b"%d" % i) == b"v"
    assert s.stats()["cache_size"] == 2
    b.set(b"3", b"w")
    assert b.get(b"3") == b"w"
    s.close()


def test_old_versions_go(spark, tmp_path):
    s = open_store(spark, f"{tmp_path}/db")
    for i in range(3):
        s.bucket("t").set(b"k", b"%d" % i)
        assert s.compact()
    assert len([p for p in (tmp_path / "db").iterdir() if p.name.startswith("v")]) == 2  # the one before lasts until close
    s.close()
    assert len([p for p in (tmp_path / "db").iterdir() if p.name.startswith("v")]) == 1
    again = open_store(spark, f"{tmp_path}/db")
    assert again.bucket("t").get(b"k") == b"2"
    again.bucket("t").set(b"k2", b"x")
    size = again.size()
    again.truncate(size - 1)
    assert not again.bucket("t").has(b"k2") and again.bucket("t").has(b"k")
    again.close()


@pytest.mark.parametrize("on, codec", [(True, "ZSTD"), (False, "UNCOMPRESSED")])
def test_compression(spark, tmp_path, on, codec):
    import pyarrow.parquet as pq

    s = open_store(spark, f"{tmp_path}/db", Options().with_compression(on, 10, 5).with_wal_disabled(False))
    seen = lambda part: {pq.ParquetFile(p).metadata.row_group(0).column(0).compression for p in (tmp_path / "db").glob(f"v*/{part}/**/*.parquet") if pq.ParquetFile(p).metadata.num_rows}
    s.bucket("t").set(b"k", b"a" * 10_000)
    assert seen("wal") == {codec}
    s.flush()
    s.compact()
    assert seen("log") == {codec} and s.bucket("t").get(b"k") == b"a" * 10_000
    s.close()


def test_maintenance_begins_on_open(spark, tmp_path):
    asked = []
    s = open_store(spark, f"{tmp_path}/db", Options().with_scheduler(lambda seconds, run: asked.append((seconds, run))).with_health(lambda name, seconds, check: asked.append((name, check()))))
    assert [a[0] for a in asked] == ["storage", 1800.0, 60.0] and asked[0][1]
    s.bucket("t").set(b"k", b"v")
    asked[2][1]()
    assert asked[-1][0] == 60.0 and s._reported == s._seq
    s.close()
    n = len(asked)
    asked[1][1]()
    assert len(asked) == n
    off = open_store(spark, f"{tmp_path}/db", Options().with_maintenance(False))
    assert not off._timers
    off.close()


def test_wal_in_the_background(spark, tmp_path):
    s = open_store(spark, f"{tmp_path}/db", Options().with_wal_disabled(False).with_wal_async(True, 0.05))
    s.bucket("t").set(b"a", b"1")
    s.bucket("t").set(b"b", b"2")
    deadline = time.time() + 20
    while s.wal.records().count() < 2 and time.time() < deadline:
        time.sleep(0.1)
    del s  # without close or flush
    again = open_store(spark, f"{tmp_path}/db")
    assert sorted(again.bucket("t").get_all()) == [(b"a", b"1"), (b"b", b"2")]
    again.close()
    w = Wal(spark, f"{tmp_path}/wal", interval_s=60)
    w.write([(1, "t", bytearray(b"k"), bytearray(b"t\0k"), "put", bytearray(b"v"))])
    assert w.size() == 0
    w.close()
    assert w.size() == 8 + 3 + 1
    with pytest.raises(Closed):
        w.write([])


def test_subscription_hooks():
    told, got = [], []
    c = Channels(on_publish=lambda bucket, channel, p: p.upper() if p != b"no" else 1 / 0, on_subscribe=lambda *a: told.append(("on", *a)), on_unsubscribe=lambda *a: told.append(("off", *a)))
    _, undo = c.subscribe("b", "ch", got.append)
    c.subscribe("b", "ch", got.append)
    assert c.publish("b", "ch", b"x") == 2 and got == [b"X", b"X"]
    with pytest.raises(PublishRefused, match="publish hook"):
        c.publish("b", "ch", b"no")
    undo()
    undo()
    c.unsubscribe_all("b", "ch")
    assert told == [("on", "b", "ch", 1), ("on", "b", "ch", 2), ("off", "b", "ch", 1), ("off", "b", "ch", 2)] and len(got) == 2


def test_deliveries_run_in_the_pool(spark, tmp_path):
    import threading

    s = open_store(spark, f"{tmp_path}/db", Options().with_pool_size(3))
    gate, seen = threading.Event(), []
    for _ in range(3):
        s.subscribe("ch", lambda p: (gate.wait(10), seen.append(threading.current_thread().name)))
    assert s.publish("ch", b"x") == 3 and not seen  # publish does not wait for slow subscribers
    gate.set()
    assert s.channels.drain(10) and len(seen) == 3 and "MainThread" not in seen
    s.close()


def test_stream_fold_goes_on(spark, tmp_path):
    from kvloom.streaming.incremental import fold_available

    rows = lambda seqs: [(i, "b", bytearray(b"k%d" % (i % 4)), bytearray(b"b\0k%d" % (i % 4)), "del" if i % 5 == 0 else "put", None if i % 5 == 0 else bytearray(b"%d" % i)) for i in seqs]
    (tmp_path / "in").mkdir()
    log = spark.readStream.schema(L.KVLOG).parquet(f"{tmp_path}/in")
    for seqs in (range(10), range(10, 26)):
        spark.createDataFrame(rows(seqs), L.KVLOG).write.mode("append").parquet(f"{tmp_path}/in")
        got = {bytes(r["user_key"]): bytes(r["value"]) for r in fold_available(log, f"{tmp_path}/fold").collect()}
        want = {b"k%d" % (i % 4): None if i % 5 == 0 else b"%d" % i for i in range(seqs.stop)}
        assert got == {k: v for k, v in want.items() if v is not None}


def test_options():
    o = Options()
    assert o.with_shards(0) == o and o.with_cardinality(True, 3).precision == 14 and o.with_bloom(0, 2.0) == o
    assert o.with_compression(True, 10, 3).compression_threshold == 10 and not o.with_wal_disabled(True).wal and o.with_pool_size(3).pool_size == 3
    assert kvloom.Options is Options
