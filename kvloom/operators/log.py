"""The change log: schema, keys, record lengths, offsets, tombstones, shards."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KVLOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("bucket", T.StringType(), False),
        T.StructField("user_key", T.BinaryType(), False),
        T.StructField("full_key", T.BinaryType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
#: Bytes of a record besides key and value: two lengths, and a flag for puts.
PUT_HEADER, DELETE_HEADER, WAL_HEADER = 9, 8, 8


def full_key(bucket: Column, key: Column) -> Column:
    """Bucket and NUL before the key; the empty bucket adds nothing."""
    return F.when(bucket == "", key).otherwise(F.concat(F.encode(bucket, "utf-8"), F.lit(b"\x00"), key))


def make_log(df: DataFrame, seq: Column, bucket: Column, key: Column, op: Column, value: Column) -> DataFrame:
    """kvlog from any relation; key and value are binary columns. seq must be unique within a key."""
    return df.select(
        seq.cast("long").alias("seq"), bucket.alias("bucket"), key.alias("user_key"), full_key(bucket, key).alias("full_key"),
        op.alias("op"), F.when(op == "put", value).alias("value"),
    )


def record_length() -> Column:
    put = F.lit(PUT_HEADER) + F.octet_length("full_key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return F.when(F.col("op") == "put", put).otherwise(F.lit(DELETE_HEADER) + F.octet_length("full_key")).cast("long")


def wal_record_length() -> Column:
    return (F.lit(WAL_HEADER) + F.octet_length("full_key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")


#: Values of `order` in a block, and blocks that are summed together, as bits.
BLOCK_BITS, GROUP_BITS = 16, 16


def running_start(df: DataFrame, order: str, length: str, out: str) -> DataFrame:
    """Adds the sum of `length` over all rows with a smaller `order`: the offset of each record in a file.

    `order` is a whole number, unique but for ties, which are put in any order, and not null. So a block of 2^16 values of it has
    no more rows than that; totals of blocks are summed by groups of 2^16 blocks, and only totals of groups meet in one place.
    Nothing runs while the plan is made.
    """
    block = F.shiftright(F.col(order).cast("long"), BLOCK_BITS)
    parts = df.withColumn("_block", block)
    totals = parts.groupBy("_block").agg(F.sum(length).alias("_total")).withColumn("_group", F.shiftright("_block", GROUP_BITS))
    groups = totals.groupBy("_group").agg(F.sum("_total").alias("_sum"))
    groups = groups.select("_group", (F.sum("_sum").over(Window.orderBy("_group")) - F.col("_sum")).alias("_before"))
    in_group = F.sum("_total").over(Window.partitionBy("_group").orderBy("_block")) - F.col("_total")
    bases = totals.withColumn("_base", in_group).join(groups, "_group").select("_block", (F.col("_base") + F.col("_before")).alias("_base"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.withColumn("_inside", F.sum(length).over(inside) - F.col(length))
        .join(bases, "_block")
        .withColumn(out, (F.col("_inside") + F.col("_base")).cast("long"))
        .drop("_block", "_inside", "_base")
    )


#: Parts that a stored log is dealt to by the first component of its keys.
PARTS = 64


def part() -> Column:
    """The part of a key: of what stands before its first NUL, or of nothing. All keys under a bucket's prefix have one part."""
    at = "locate('\\u0000', decode(full_key, 'ISO-8859-1'))"
    root = F.expr(f"if({at} > 0, substring(full_key, 1, {at} - 1), cast('' as binary))")
    return F.pmod(F.crc32(root), F.lit(PARTS)).cast("int")


def part_of(key: bytes) -> int:
    """As part(), of a key or of a bucket's prefix."""
    root, found, _ = key.partition(b"\0")
    return zlib.crc32(root if found else b"") % PARTS


def truncate(log: DataFrame, size: int) -> DataFrame:
    """The records that lie wholly before byte `size`."""
    placed = running_start(log.withColumn("_len", record_length()), "seq", "_len", "_offset")
    return placed.filter(F.col("_offset") + F.col("_len") <= size).select(*log.columns)


def record_at(log: DataFrame, offset: int | DataFrame) -> DataFrame:
    """The record that starts at a byte offset, or none. The offset is a number, or a frame of one."""
    placed = running_start(log.withColumn("_len", record_length()), "seq", "_len", "_offset")
    if isinstance(offset, DataFrame):
        return placed.join(F.broadcast(offset.toDF("_wanted")), F.col("_offset") == F.col("_wanted"), "left_semi").select(*log.columns)  # one row
    return placed.filter(F.col("_offset") == offset).select(*log.columns)


def shard_count(n: int) -> int:
    """The next power of two; 64 if n isn't positive."""
    return 64 if n <= 0 else 1 << (n - 1).bit_length()


def shard(n: int) -> Column:
    return F.pmod(F.xxhash64("full_key"), F.lit(shard_count(n))).cast("int")


def is_empty(log: DataFrame) -> bool:
    return log.isEmpty()


def logical_size(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.sum(record_length()), F.lit(0)).cast("long").alias("logical_offset"))


def tombstones(log: DataFrame) -> DataFrame:
    return log.filter(F.col("op") == "del").groupBy("bucket").agg(F.count("*").alias("n"))


def compressible(values: DataFrame, column: str, threshold: int = 4096) -> DataFrame:
    """Adds whether a value is long enough to be compressed."""
    return values.withColumn("n_bytes", F.octet_length(column).cast("long")).withColumn("eligible", F.col("n_bytes") >= threshold)
