"""KVStore: buckets over a versioned Parquet log.

Layout: <root>/_CURRENT names the version; <root>/<version>/log holds kvlog in parts by the first component of a key, each file
sorted by key; <root>/<version>/wal, if on, the unflushed batches. Reads of a key or a bucket go to one part, and to the row
groups that can hold the key. One writer allocates seq on the driver and buffers writes; flush() appends them as one Spark job.
Reads see the buffer. compact() folds a snapshot into a new version and swaps _CURRENT; an old version is never written again,
and is deleted when the store is closed or compacted once more, so that frames read from it last until then.
"""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.config import Options
from kvloom.errors import Closed, EmptyKey, KeyNotFound, StoreError
from kvloom.functions.handlers import Handlers
from kvloom.operators import maintenance, reads, sketches
from kvloom.operators import stats as st
from kvloom.operators.fold import latest
from kvloom.operators.log import KVLOG, make_log, part, part_of, record_length, running_start, truncate
from kvloom.sources import files
from kvloom.sources.wal import Wal
from kvloom.streaming.pubsub import Channels


STORED = T.StructType([*KVLOG.fields, T.StructField("part", T.IntegerType())])


def open_store(spark: SparkSession, root: str, options: Options | None = None, create: bool = True) -> KVStore:
    return KVStore(spark, root, options or Options(), create)


class KVStore:
    def __init__(self, spark: SparkSession, root: str, options: Options, create: bool = True) -> None:
        parent = root.rstrip("/").rpartition("/")[0]
        if parent and not files.exists(spark, parent):
            raise StoreError(f"{parent} does not exist")
        self.spark, self.root, self.options = spark, root.rstrip("/"), options
        self._lock, self._closed, self._buffer, self._fold = threading.RLock(), False, [], None
        #: Last buffered record of each key, and values read before, the least recently read first.
        self._unflushed: dict[bytes, bytes | None] = {}
        self._cache: OrderedDict[bytes, bytes] = OrderedDict()
        self._pool = options.executor or ThreadPoolExecutor(max_workers=options.pool_size)
        self.handlers = Handlers(options.call_timeout_s)
        self.channels = Channels(options.logger, pool=self._pool)
        if files.exists(spark, f"{self.root}/_CURRENT"):
            self.version = files.read_text(spark, f"{self.root}/_CURRENT").strip()
        elif create:
            self.version = "v000001"
            self._write(spark.createDataFrame([], KVLOG), self.version)
            files.replace_text(spark, f"{self.root}/_CURRENT", self.version)
        else:
            raise StoreError(f"no store at {root}")
        self._recover()
        self.wal = self._new_wal() if options.wal else None
        self._seq = self._durable().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        self._timers: dict[str, threading.Timer] = {}
        self._reported = -1
        if options.health is not None:
            options.health("storage", 30.0, self.healthy)
        if options.maintenance:
            self.start_maintenance()

    # --- lifecycle ---------------------------------------------------------

    def _recover(self) -> None:
        """Batches of a write-ahead log that were not flushed come into the log."""
        wal = Wal(self.spark, f"{self.root}/{self.version}/wal")
        if files.exists(self.spark, wal.path):
            done = self._durable().select("seq")
            self._write(wal.records().join(done, "seq", "left_anti").select(*KVLOG.names), self.version)
            wal.drop()

    def _new_wal(self) -> Wal:
        o = self.options
        return Wal(self.spark, f"{self.root}/{self.version}/wal", o.wal_interval_s if o.wal_async else None, o.wal_buffer, self._codec(), o.logger)

    def _codec(self) -> dict:
        o = self.options
        return {"compression": "zstd", "parquet.compression.codec.zstd.level": str(o.compression_level or 3)} if o.compression else {"compression": "uncompressed"}

    def _write(self, log: DataFrame, version: str, whole: bool = False) -> None:
        """Adds records to a version's log, dealt to parts and sorted by key; a whole log also in ranges of keys, so that its files don't overlap."""
        parts = log.select(*KVLOG.names).withColumn("part", part())
        parts = parts.repartitionByRange("part", "full_key") if whole else parts
        parts.sortWithinPartitions("part", "full_key", "seq").write.mode("append").options(**self._codec()).partitionBy("part").parquet(f"{self.root}/{version}/log")

    def _durable(self, prefix: bytes = b"") -> DataFrame:
        """The log of the current version, or as much of it as can hold keys with this prefix, which ends a component, or this key."""
        log = self.spark.read.schema(STORED).parquet(f"{self.root}/{self.version}/log")
        return (log.filter(F.col("part") == part_of(prefix)) if prefix else log).select(*KVLOG.names)

    def _check(self) -> None:
        if self._closed:
            raise Closed("the store was closed")

    def _changed(self) -> None:
        if self._fold is not None:
            self._fold.unpersist()
            self._fold = None

    def flush(self) -> None:
        """The buffer becomes one batch of the log, then the write-ahead log goes."""
        with self._lock:
            self._check()
            if self._buffer:
                self._write(self.spark.createDataFrame(self._buffer, KVLOG), self.version)
                self._buffer, self._unflushed = [], {}  # not before they are durable
                self._changed()
            if self.wal:
                self.wal.drop()

    def close(self) -> None:
        with self._lock:
            self.flush()
            for timer in self._timers.values():
                timer.cancel()
            self.channels.stop()
            self._changed()
            if self.wal:
                self.wal.close()
            if self.options.executor is None:
                self._pool.shutdown(wait=False)
            self._delete_old_versions([self.version])
            self._closed = True

    def healthy(self) -> bool:
        return not self._closed and files.exists(self.spark, f"{self.root}/_CURRENT") and self.spark.sql("SELECT 1").count() == 1

    # --- writes ------------------------------------------------------------

    def _append(self, rows: list[tuple[str, bytes, str, bytes | None]]) -> None:
        with self._lock:
            self._check()
            made = []
            for bucket, key, op, value in rows:
                if not key:
                    raise EmptyKey("empty key")
                self._seq += 1
                made.append((self._seq, bucket, bytearray(key), bytearray(reads.qualify(bucket, key)), op, None if value is None else bytearray(value)))
            if self.wal:
                self.wal.write(made)
            self._buffer += made
            for _, _, _, full, _, value in made:
                self._unflushed[bytes(full)] = None if value is None else bytes(value)
                self._cache.pop(bytes(full), None)
            self._changed()
            if len(self._buffer) >= self.options.batch_max:
                self.flush()

    def append(self, records: DataFrame) -> None:
        """A DataFrame of (bucket, user_key, op, value, position) as one batch, in the order of position, a whole number; of equal
        positions in any order. Every record is logged with a seq of its own, so later ones win and all count. No row passes the
        driver. The batch is durable as a whole or not at all, so it doesn't go through the write-ahead log."""
        with self._lock:
            self._check()
            self.flush()
            if not records.filter(F.col("user_key").isNull() | (F.octet_length("user_key") == 0)).isEmpty():
                raise EmptyKey("empty key")
            numbered = running_start(records.withColumn("_one", F.lit(1)), "position", "_one", "_before")
            log = make_log(numbered, F.lit(self._seq + 1) + F.col("_before"), F.col("bucket"), F.col("user_key"), F.col("op"), F.col("value"))
            last = Observation()
            self._write(log.observe(last, F.max("seq").alias("seq")), self.version)
            self._seq = last.get["seq"] or self._seq
            self._cache.clear()
            self._changed()

    # --- reads -------------------------------------------------------------

    def log(self, prefix: bytes = b"") -> DataFrame:
        """All records, or as many as can hold keys with a bucket's prefix."""
        with self._lock:
            self._check()
            log = self._durable(prefix)
            return log.unionByName(self.spark.createDataFrame(self._buffer, KVLOG)) if self._buffer else log

    def latest(self, persist: bool = False) -> DataFrame:
        """The fold; with persist it is kept until the next write."""
        with self._lock:
            if not persist:
                return self._fold or latest(self.log())
            if self._fold is None:
                self._fold = latest(self.log()).persist()
            return self._fold

    def value(self, full: bytes) -> bytes | None:
        """The live value of a full key: from unflushed writes, from values read before, or from the key's part of the log."""
        with self._lock:
            self._check()
            if full in self._unflushed:
                return self._unflushed[full]
            if full in self._cache:
                self._cache.move_to_end(full)
                return self._cache[full]
            row = reads.get(self._durable(full), "", full).select("value").first()
            if row is None:
                return None
            self._cache[full] = bytes(row[0])
            while len(self._cache) > self.options.cache_size:
                self._cache.popitem(last=False)
            return self._cache[full]

    def bucket(self, name: str) -> Bucket:
        self._check()
        return Bucket(self, name)

    # --- maintenance -------------------------------------------------------

    def compact(self) -> bool:
        """The log becomes a new version with one put for each live key; False if there is nothing in it."""
        with self._lock:
            self.flush()
            log = self._durable()
            if log.isEmpty():
                return False
            self._replace(maintenance.compacted(log))
            return True

    def truncate(self, size: int) -> None:
        """Keeps the records that lie wholly before byte `size` of the log."""
        with self._lock:
            self.flush()
            self._replace(truncate(self._durable(), size))

    def _replace(self, log: DataFrame) -> None:
        version, replaced = f"v{int(self.version[1:7]) + 1:06d}-{uuid.uuid4().hex[:8]}", self.version
        self._write(log, version, whole=True)
        files.replace_text(self.spark, f"{self.root}/_CURRENT", version)
        self.version = version
        if self.wal:
            self.wal.close()
            self.wal = self._new_wal()
        self._cache.clear()
        self._changed()
        self._delete_old_versions([version, replaced])

    def _delete_old_versions(self, keep: list[str]) -> None:
        for name in files.children(self.spark, self.root):
            if name.startswith("v") and name not in keep:
                files.delete(self.spark, f"{self.root}/{name}")

    def compact_if_needed(self) -> bool:
        log = self.log()
        if st.num_keys(log).first()["num_keys"] < self.options.compaction_min_items:
            return False
        if st.fragmentation(log).first()["fragmentation"] <= self.options.compaction_threshold:
            return False
        return self.compact()

    def report(self) -> None:
        """Logs statistics, if something was written since the last time."""
        if self._seq != self._reported:
            self._reported = self._seq
            self.options.logger.info("stats %s", self.stats())

    def start_maintenance(self) -> None:
        """Compaction checks and reports, each at its interval, on timers or on the injected scheduler."""
        self._every("compaction", self.options.compaction_interval_s, self.compact_if_needed)
        self._every("report", self.options.report_interval_s, self.report)

    def _every(self, name: str, seconds: float, work: Callable[[], object]) -> None:
        def run() -> None:
            if self._closed:
                return
            try:
                work()
            except Exception:
                self.options.logger.exception("%s failed", name)
            self._every(name, seconds, work)

        if self._closed:
            return
        if self.options.scheduler is not None:
            self.options.scheduler(seconds, run)
            return
        timer = self._timers[name] = threading.Timer(seconds, run)
        timer.daemon = True
        timer.start()

    # --- statistics --------------------------------------------------------

    def stats(self) -> dict:
        o = self.options
        row = st.stats(self.log(), o.precision, o.bloom_items, o.bloom_fpr).first().asDict()
        row["file_size_bytes"] = files.bytes_under(self.spark, f"{self.root}/{self.version}")
        row["cache_size"] = len(self._cache)
        return row if o.cardinality else row | {"estimated_keys": 0}

    def size(self) -> int:
        return self.log().agg(F.coalesce(F.sum(record_length()), F.lit(0))).first()[0]

    def estimated_key_count(self) -> int:
        return sketches.estimated_keys(self.log(), self.options.precision).first()[0] if self.options.cardinality else 0

    def key_frequency(self, full_key: bytes) -> int:
        if not self.options.frequency:
            return 0
        return sketches.puts(self.log()).filter(F.col("full_key") == F.lit(full_key)).count()

    # --- messaging ---------------------------------------------------------

    def register_handler(self, name: str, fn: Callable[[bytes], bytes]) -> None:
        self.handlers.register(name, fn)

    def unregister_handler(self, name: str) -> None:
        self.handlers.unregister(name)

    def call(self, name: str, payload: bytes) -> bytes:
        return self.handlers.call(name, payload)

    def call_direct(self, name: str, payload: bytes) -> bytes:
        return self.handlers.call_direct(name, payload)

    def publish(self, channel: str, payload: bytes) -> int:
        return self.channels.publish("", channel, payload)

    def subscribe(self, channel: str, fn: Callable[[bytes], None]) -> Callable[[], None]:
        return self.channels.subscribe("", channel, fn)[1]

    def subscribe_with_id(self, channel: str, fn: Callable[[bytes], None]) -> tuple[int, Callable[[], None]]:
        return self.channels.subscribe("", channel, fn)

    def unsubscribe_all(self, channel: str) -> None:
        self.channels.unsubscribe_all("", channel)

    def subscription_count(self, channel: str) -> int:
        return self.channels.count("", channel)

    def subscription_ids(self, channel: str) -> list[int]:
        return self.channels.ids("", channel)


class Bucket:
    """A namespace by byte prefix. The empty name sees the keys of all buckets, unstripped."""

    def __init__(self, store: KVStore, name: str) -> None:
        self.store, self.name = store, name

    def set(self, key: bytes, value: bytes) -> None:
        if not key:
            raise EmptyKey("empty key")
        self.store._append([(self.name, key, "put", value)])

    def batch_set(self, pairs: Iterable[tuple[bytes, bytes]]) -> None:
        self.store._append([(self.name, k, "put", v) for k, v in pairs])

    def delete(self, key: bytes) -> None:
        """A tombstone; the key need not exist."""
        self.store._append([(self.name, key, "del", None)])

    def get(self, key: bytes) -> bytes:
        if not key:
            raise EmptyKey("empty key")
        value = self.store.value(reads.qualify(self.name, key))
        if value is None:
            raise KeyNotFound(key)
        return value

    def has(self, key: bytes) -> bool:
        try:
            self.get(key)
        except StoreError:
            return False
        return True

    def frame(self) -> DataFrame:
        """Live pairs (key, value) of the bucket, from its part of the log."""
        return reads.scan(self.store.log(reads.prefix_of(self.name)), self.name)

    def get_all(self) -> list[tuple[bytes, bytes]]:
        return list(self._rows())

    def _rows(self) -> Iterator[tuple[bytes, bytes]]:
        for r in self.frame().toLocalIterator():
            yield bytes(r["key"]), bytes(r["value"])

    def scan(self, fn: Callable[[bytes, bytes], bool]) -> None:
        """Calls fn until it returns false; partitions after that are not fetched."""
        for key, value in self._rows():
            if not fn(key, value):
                return

    def estimated_key_count(self) -> int:
        """Of the whole store, as the engine this one replaces reports it; keys_in_bucket() is the bucket's own."""
        return self.store.estimated_key_count()

    def keys_in_bucket(self) -> int:
        return self.frame().count()

    def key_frequency(self, key: bytes) -> int:
        return self.store.key_frequency(reads.qualify(self.name, key))

    def _handler(self, name: str) -> str:
        return f"{self.name}\0{name}"

    def register_handler(self, name: str, fn: Callable[[bytes], bytes]) -> None:
        self.store.handlers.register(self._handler(name), fn)

    def unregister_handler(self, name: str) -> None:
        self.store.handlers.unregister(self._handler(name))

    def call(self, name: str, payload: bytes) -> bytes:
        return self.store.handlers.call(self._handler(name), payload)

    def call_direct(self, name: str, payload: bytes) -> bytes:
        return self.store.handlers.call_direct(self._handler(name), payload)

    def publish(self, channel: str, payload: bytes) -> int:
        return self.store.channels.publish(self.name, f"{self.name}\0{channel}", payload)

    def subscribe(self, channel: str, fn: Callable[[bytes], None]) -> Callable[[], None]:
        return self.subscribe_with_id(channel, fn)[1]

    def subscribe_with_id(self, channel: str, fn: Callable[[bytes], None]) -> tuple[int, Callable[[], None]]:
        return self.store.channels.subscribe(self.name, f"{self.name}\0{channel}", fn)

    def unsubscribe_all(self, channel: str) -> None:
        self.store.channels.unsubscribe_all(self.name, f"{self.name}\0{channel}")

    def subscription_count(self, channel: str) -> int:
        return self.store.channels.count(self.name, f"{self.name}\0{channel}")

    def subscription_ids(self, channel: str) -> list[int]:
        return self.store.channels.ids(self.name, f"{self.name}\0{channel}")


__all__ = ["Bucket", "KVStore", "open_store"]
