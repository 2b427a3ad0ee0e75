"""State of a log: the last record of each key, if it is a put."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_records(log: DataFrame) -> DataFrame:
    """The last record of each key, tombstones included. A record stands once in the log, with a seq of its own within its key.

    Only keys and seq are aggregated, in hash maps that combine a hot key before the exchange; the records they choose are
    joined by (full_key, seq), so a hot key's old versions are dealt out too. Few keys are broadcast by the session's own bound.
    """
    last = log.groupBy("full_key").agg(F.max("seq").alias("seq"))
    return log.join(last, ["full_key", "seq"], "left_semi").select("full_key", "bucket", "user_key", "op", "value", "seq")


def latest(log: DataFrame) -> DataFrame:
    """Live keys and values. Filters on full_key or bucket pass below the exchange when given to the log first."""
    return last_records(log).filter(F.col("op") == "put").select("full_key", "bucket", "user_key", "value", "seq")


def latest_of_few(records: DataFrame) -> DataFrame:
    """As latest(), of a log that was cut down to few records: read once, with the records themselves in a sorted aggregate."""
    last = F.max_by(F.struct("bucket", "user_key", "op", "value"), F.col("seq"))
    found = records.groupBy("full_key").agg(last.alias("r"), F.max("seq").alias("seq")).filter("r.op = 'put'")
    return found.select("full_key", "r.bucket", "r.user_key", "r.value", "seq")


def live_keys(log: DataFrame) -> DataFrame:
    """The keys of latest(), without their values."""
    keys = log.groupBy("full_key").agg(F.max_by(F.col("op") == "put", "seq").alias("live"))
    return keys.filter("live").select("full_key")
