"""Reads: get, has, multi-get, bucket and cross-bucket scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.operators.fold import latest, latest_of_few, live_keys


def qualify(bucket: str, key: bytes) -> bytes:
    return key if bucket == "" else bucket.encode() + b"\x00" + key


def prefix_of(bucket: str) -> bytes:
    return b"" if bucket == "" else bucket.encode() + b"\x00"


def in_bucket(bucket: str) -> Column:
    """Keys under the bucket's byte prefix, which other buckets' names may hold too."""
    return F.lit(True) if bucket == "" else F.startswith(F.col("full_key"), F.lit(prefix_of(bucket)))


def get(log: DataFrame, bucket: str, key: bytes) -> DataFrame:
    """The value of a key: its last record, by a filter that reaches the scan and a top 1 of each task, without a shuffle of records."""
    last = log.filter(F.col("full_key") == F.lit(qualify(bucket, key))).orderBy(F.desc("seq")).limit(1)
    return last.filter(F.col("op") == "put").select("full_key", "value")


def scan(log: DataFrame, bucket: str) -> DataFrame:
    """All live pairs of a bucket with keys as the user wrote them; the empty name scans everything with raw keys."""
    live = latest(log.filter(in_bucket(bucket)))
    return live.select(F.expr(f"substring(full_key, {len(prefix_of(bucket)) + 1})").alias("key"), "value")


def scan_first(log: DataFrame, bucket: str, n: int) -> DataFrame:
    """The first n pairs in key order."""
    return scan(log, bucket).orderBy("key").limit(n)


def multi_get(probes: DataFrame, log: DataFrame) -> DataFrame:
    """probes(full_key) with their values, null where there is none. The log is cut down to the probed keys before it is folded."""
    keys = probes.select("full_key").distinct()
    return probes.join(latest_of_few(log.join(keys, "full_key", "left_semi")).select("full_key", "value"), "full_key", "left")


def _live_probes(probes: DataFrame, log: DataFrame) -> DataFrame:
    """Probed keys that are live: the log is cut down to them first, and values are not read."""
    return live_keys(log.join(probes.select("full_key").distinct(), "full_key", "left_semi"))


def has(probes: DataFrame, log: DataFrame) -> DataFrame:
    return probes.join(_live_probes(probes, log), "full_key", "left_semi")


def missing(probes: DataFrame, log: DataFrame) -> DataFrame:
    return probes.join(_live_probes(probes, log), "full_key", "left_anti")
