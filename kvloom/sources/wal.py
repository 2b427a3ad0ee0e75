"""A write-ahead log as a directory of Parquet batches in kvlog's schema."""

from __future__ import annotations

import logging
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.errors import Closed
from kvloom.operators.log import KVLOG, WAL_HEADER, running_start, wal_record_length
from kvloom.sources import files


class Wal:
    """append() and write() make a batch durable; records() reads all batches in any order; drop() starts afresh.

    With interval_s, write() only queues its rows. A thread makes what is queued durable as one batch at every interval, and as
    soon as buffer_bytes wait; flush() and close() do so at once. Rows whose batch fails stay in the queue.
    """

    def __init__(self, spark: SparkSession, path: str, interval_s: float | None = None, buffer_bytes: int = 4 << 20, codec: dict | None = None, logger: logging.Logger | None = None) -> None:
        self.spark, self.path, self.closed, self.codec = spark, path, False, codec or {}
        self.buffer_bytes, self._log = buffer_bytes, logger or logging.getLogger("kvloom")
        self._lock, self._queue, self._waiting, self._full = threading.RLock(), [], 0, threading.Event()
        self._thread = None
        if interval_s:
            self._thread = threading.Thread(target=self._flusher, args=(interval_s,), daemon=True)
            self._thread.start()

    def append(self, records: DataFrame) -> None:
        if self.closed:
            raise Closed("the log was closed")
        records.write.mode("append").options(**self.codec).parquet(self.path)

    def write(self, rows: list[tuple]) -> None:
        """Rows of kvlog."""
        if self.closed:
            raise Closed("the log was closed")
        if self._thread is None:
            self.append(self.spark.createDataFrame(rows, KVLOG))
            return
        with self._lock:
            self._queue += rows
            self._waiting += sum(WAL_HEADER + len(r[3]) + len(r[5] or b"") for r in rows)
            if self._waiting >= self.buffer_bytes:
                self._full.set()

    def flush(self) -> None:
        with self._lock:
            if self._queue:
                self.append(self.spark.createDataFrame(self._queue, KVLOG))
                self._queue, self._waiting = [], 0
            self._full.clear()

    def _flusher(self, interval_s: float) -> None:
        while not self.closed:
            self._full.wait(interval_s)
            try:
                if not self.closed:
                    self.flush()
            except Exception:
                self._full.clear()
                self._log.exception("the write-ahead log was not flushed")

    def records(self) -> DataFrame:
        if not files.exists(self.spark, self.path):
            return self.spark.createDataFrame([], KVLOG)
        return self.spark.read.schema(KVLOG).parquet(self.path)

    def placed(self) -> DataFrame:
        """Records with their byte offset."""
        return wal_offsets(self.records())

    def read(self, offset: int) -> DataFrame:
        return self.placed().filter(F.col("wal_offset") == offset)

    def between(self, start: int, end: int) -> DataFrame:
        """Records that start in [start, end), in file order."""
        return self.placed().filter((F.col("wal_offset") >= start) & (F.col("wal_offset") < end)).orderBy("wal_offset")

    def read_next(self):
        """Records one by one in file order."""
        yield from self.records().orderBy("seq").toLocalIterator()

    def size(self) -> int:
        return self.records().agg(F.coalesce(F.sum(wal_record_length()), F.lit(0))).first()[0]

    def file_size(self) -> int:
        return files.bytes_under(self.spark, self.path)

    def drop(self) -> None:
        with self._lock:
            self._queue, self._waiting = [], 0
            files.delete(self.spark, self.path)

    def close(self) -> None:
        if not self.closed:
            self.flush()
        self.closed = True
        self._full.set()


def wal_offsets(records: DataFrame) -> DataFrame:
    return running_start(records.withColumn("_len", wal_record_length()), "seq", "_len", "wal_offset").drop("_len")
