"""One-row statistics of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.operators.fold import live_keys
from kvloom.operators.log import record_length
from kvloom.operators.sketches import bloom_fpr, hll, puts


def num_keys(log: DataFrame) -> DataFrame:
    return live_keys(log).agg(F.count("*").alias("num_keys"))


def fragmentation(log: DataFrame) -> DataFrame:
    """Share of bytes that no live key needs. One exchange: bytes are summed beside the fold."""
    by_key = log.withColumn("_len", record_length()).groupBy("full_key").agg(
        F.max_by(F.when(F.col("op") == "put", F.col("_len")).otherwise(0), "seq").alias("live"), F.sum("_len").alias("total")
    )
    live, total = F.coalesce(F.sum("live"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))
    return by_key.agg(total.alias("total_bytes"), live.alias("live_bytes")).select(
        "total_bytes", "live_bytes", F.when(F.col("total_bytes") > 0, 1 - F.col("live_bytes") / F.col("total_bytes")).otherwise(0.0).alias("fragmentation")
    )


def bloom_stats(log: DataFrame, items: int = 1_000_000, fpr: float = 0.01) -> DataFrame:
    """Insertions count calls: before the first compaction each put adds twice (index and metrics)."""
    n = puts(log).agg((2 * F.count("*")).alias("bloom_insertions"))
    return n.select("bloom_insertions", bloom_fpr(F.col("bloom_insertions"), items, fpr).alias("bloom_fpr"))


def stats(log: DataFrame, precision: int = 14, items: int = 1_000_000, fpr: float = 0.01) -> DataFrame:
    """num_keys, logical_offset, bloom_insertions, bloom_fpr, estimated_keys, and keys_ever exactly, in one pass over the folded keys."""
    by_key = log.withColumn("_len", record_length()).groupBy("full_key").agg(
        F.max_by(F.col("op") == "put", "seq").alias("live"), F.sum("_len").alias("bytes"), F.count_if(F.col("op") == "put").alias("puts")
    )
    ever = F.when(F.col("puts") > 0, F.col("full_key"))
    row = by_key.withColumn("ever", ever).agg(
        F.count_if("live").alias("num_keys"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("logical_offset"),
        (2 * F.coalesce(F.sum("puts"), F.lit(0))).alias("bloom_insertions"), F.coalesce(F.hll_sketch_estimate(hll("ever", precision)), F.lit(0)).alias("estimated_keys"),
        F.count("ever").alias("keys_ever"),
    )
    return row.withColumn("bloom_fpr", bloom_fpr(F.col("bloom_insertions"), items, fpr))

