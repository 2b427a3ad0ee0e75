"""Compaction and replay as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.operators.fold import latest


def compacted(log: DataFrame) -> DataFrame:
    """A log with one put for each live key. Records keep their seq, so a later tombstone still wins."""
    return latest(log).select("seq", "bucket", "user_key", "full_key", F.lit("put").alias("op"), "value")


def with_tail(base: DataFrame, tail: DataFrame) -> DataFrame:
    """A compacted log and what was written since."""
    return base.unionByName(tail)


def replay(base: DataFrame, wal: DataFrame) -> DataFrame:
    """State after recovery. A record that is in both logs has one seq and counts once, as the write-ahead log has it."""
    place = F.shiftleft(F.col("seq"), 1)
    both = base.withColumn("seq", place).unionByName(wal.withColumn("seq", place.bitwiseOR(F.lit(1))))
    return latest(both).withColumn("seq", F.shiftright("seq", 1))
