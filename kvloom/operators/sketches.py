"""Cardinality, frequency and membership over the key stream: exact, and as mergeable sketches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def puts(log: DataFrame) -> DataFrame:
    return log.filter(F.col("op") == "put")


# --- cardinality -----------------------------------------------------------


def hll(column: str = "full_key", precision: int = 14) -> Column:
    return F.hll_sketch_agg(column, F.lit(max(4, min(16, precision))))


def estimated_keys(log: DataFrame, precision: int = 14) -> DataFrame:
    """Distinct keys ever put; deletes do not subtract."""
    return puts(log).agg(F.hll_sketch_estimate(hll(precision=precision)).alias("estimated_keys"))


def estimated_keys_by_bucket(log: DataFrame, precision: int = 14) -> DataFrame:
    return puts(log).groupBy("bucket").agg(F.hll_sketch_estimate(hll(precision=precision)).alias("estimated_keys"))


def hll_merged(log: DataFrame, by: str = "bucket", precision: int = 14) -> DataFrame:
    """Partial sketches by group, merged into one estimate."""
    parts = puts(log).groupBy(by).agg(hll(precision=precision).alias("s"))
    return parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("estimated_keys"))


def exact_keys_by_bucket(log: DataFrame) -> DataFrame:
    return puts(log).groupBy("bucket").agg(F.countDistinct("full_key").alias("n_keys"))


# --- frequency -------------------------------------------------------------


def key_frequency(log: DataFrame) -> DataFrame:
    return puts(log).groupBy("full_key").agg(F.count("*").alias("n"))


def cms_width(eps: float) -> int:
    return 1 << max(0, math.ceil(math.e / eps) - 1).bit_length()


def cms_depth(delta: float) -> int:
    return max(1, math.ceil(math.log(1 / delta)))


def _cell(key: Column, row: Column, width: int) -> Column:
    return F.pmod(F.xxhash64(key, row), F.lit(width))


def cms(keys: DataFrame, eps: float = 0.01, depth: int = 7, key: str = "full_key") -> DataFrame:
    """Count-min cells (row, cell, n). Repeats of a key are summed before they fan out to the rows."""
    counted = keys.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("c"))
    spread = counted.select("k", "c", F.explode(F.array(*[F.lit(i) for i in range(depth)])).alias("row"))
    return spread.groupBy("row", _cell(F.col("k"), F.col("row"), cms_width(eps)).alias("cell")).agg(F.sum("c").alias("n"))


def cms_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "cell").agg(F.sum("n").alias("n"))


def cms_estimate(probes: DataFrame, cells: DataFrame, eps: float = 0.01, depth: int = 7, key: str = "full_key") -> DataFrame:
    """probes with the least count over the rows. The cells (depth x width of them at most) are the small side."""
    k = probes.select(F.col(key)).distinct()
    spread = k.select(key, F.explode(F.array(*[F.lit(i) for i in range(depth)])).alias("row")).withColumn("cell", _cell(F.col(key), F.col("row"), cms_width(eps)))
    small = F.broadcast(cells) if depth * cms_width(eps) <= 1 << 20 else cells
    return spread.join(small, ["row", "cell"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).cast("long").alias("estimate"))


# --- membership ------------------------------------------------------------


def bloom_size(items: int, fpr: float) -> tuple[int, int]:
    """Bits and hash functions."""
    items, fpr = max(1, items), fpr if 0 < fpr < 1 else 0.01
    m = math.ceil(-items * math.log(fpr) / math.log(2) ** 2)
    return m, math.ceil(math.log(2) * m / items)


def bloom_fpr(insertions: Column, items: int, fpr: float) -> Column:
    m, k = bloom_size(items, fpr)
    return F.pow(1 - F.exp(-F.lit(float(k)) * insertions / F.lit(float(m))), F.lit(float(k)))


def bloom_bits(keys: DataFrame, items: int = 1_000_000, fpr: float = 0.01, key: str = "full_key") -> DataFrame:
    """The filter as a relation of set bits, folded into 64-bit words: (word, bits)."""
    m, k = bloom_size(items, fpr)
    bit = keys.select(F.explode(_positions(F.col(key), m, k)).alias("bit"))
    word = F.shiftrightunsigned("bit", 6).alias("word")
    return bit.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))


def _position(key: Column, i: int, m: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(i)), F.lit(m))


def _positions(key: Column, m: int, k: int) -> Column:
    return F.array(*[_position(key, i, m) for i in range(k)])


#: Filters of up to so many bits (16 MB) are tested inside each row; larger ones are joined in a shuffle.
INLINE_BITS = 1 << 27


def bloom_test(probes: DataFrame, bits: DataFrame, items: int = 1_000_000, fpr: float = 0.01, key: str = "full_key", keep: tuple[str, ...] = ()) -> DataFrame:
    """probes (the key, and columns to keep) with `maybe`: false only for keys that were never added. Probes don't move to meet a
    filter of bounded size: it is one value of the plan."""
    m, k = bloom_size(items, fpr)
    if m <= INLINE_BITS:
        every = bits.sparkSession.range((m >> 6) + 1).withColumnRenamed("id", "word").join(bits, "word", "left")
        words = F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"])
        filter_ = every.agg(words.alias("words")).scalar()
        maybe = F.lit(True)
        for i in range(k):
            bit = _position(F.col(key), i, m)
            maybe = maybe & (F.getbit(F.get(filter_, F.shiftrightunsigned(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return probes.select(F.col(key), *keep, maybe.alias("maybe"))
    p = probes.select(F.col(key)).distinct().select(key, F.explode(_positions(F.col(key), m, k)).alias("bit"))
    p = p.withColumn("word", F.shiftrightunsigned("bit", 6)).join(bits, "word", "left")
    set_here = F.expr("coalesce(shiftrightunsigned(bits, cast(bit & 63 as int)) & 1L, 0L)")
    found = p.groupBy(key).agg((F.min(set_here) == 1).alias("maybe"))
    return probes.select(F.col(key), *keep).join(found, key).select(key, *keep, "maybe")
