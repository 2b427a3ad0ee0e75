"""The single-file binary layout: export to it and import from it.

Record: u32 big-endian key length, key, u32 value length, then for a put one flag byte (1: zstandard) and the value.
A deletion has value length 0 and no flag. Eight zero bytes are padding and end the log, as does a record that is cut off.
An empty value can't be told from a deletion in this layout, so export refuses it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField("offset", T.LongType()), T.StructField("full_key", T.BinaryType()), T.StructField("op", T.StringType()), T.StructField("value", T.BinaryType())])


def encode(key: bytes, value: bytes | None, threshold: int | None = None) -> bytes:
    if not key:
        raise ValueError("an empty key has no record")
    if value is None:
        return struct.pack(">I", len(key)) + key + struct.pack(">I", 0)
    if not value:
        raise ValueError("this layout has no empty values")
    flag = threshold is not None and len(value) >= threshold
    if flag:
        import zstandard

        value = zstandard.ZstdCompressor().compress(value)
    return b"".join((struct.pack(">I", len(key)), key, struct.pack(">IB", len(value), flag), value))


def decode(data: bytes) -> Iterator[tuple[int, bytes, str, bytes | None]]:
    at, end = 0, len(data)
    while at + 8 <= end:
        start = at
        (n,) = struct.unpack_from(">I", data, at)
        if n == 0 or at + 8 + n > end:
            return
        key = data[at + 4 : at + 4 + n]
        (m,) = struct.unpack_from(">I", data, at + 4 + n)
        at += 8 + n
        if m == 0:
            yield start, key, "del", None
            continue
        if at + 1 + m > end:
            return
        value, flag = data[at + 1 : at + 1 + m], data[at]
        at += 1 + m
        if flag == 1:
            import zstandard

            value = zstandard.ZstdDecompressor().decompressobj().decompress(value)
        yield start, key, "put", value


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Records of binary logs. A file can't be split, for a record's start is known only from the one before; files are read side by side."""

    def rows(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                chunk: list = []
                for r in decode(bytes(content)):
                    chunk.append(r)
                    if len(chunk) == 4096:
                        yield pd.DataFrame(chunk, columns=RAW.names)
                        chunk = []
                if chunk:
                    yield pd.DataFrame(chunk, columns=RAW.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, RAW)


def to_raw(log: DataFrame, threshold: int | None = None) -> DataFrame:
    """(seq, record) in the binary layout; sorted by seq and joined, the records make a file."""

    def rows(batches):
        for b in batches:
            b["record"] = [encode(bytes(k), None if op == "del" else bytes(v), threshold) for k, op, v in zip(b["full_key"], b["op"], b["value"], strict=True)]
            yield b[["seq", "record"]]

    return log.select("seq", "full_key", "op", "value").mapInPandas(rows, "seq long, record binary")


def as_log(raw: DataFrame) -> DataFrame:
    """kvlog of imported records; the offset is the order, and the bucket ends at the first NUL of the key."""
    split = F.expr("locate('\\u0000', decode(full_key, 'ISO-8859-1'))")
    bucket = F.when(split > 0, F.decode(F.expr("substring(full_key, 1, locate('\\u0000', decode(full_key, 'ISO-8859-1')) - 1)"), "utf-8")).otherwise("")
    key = F.when(split > 0, F.expr("substring(full_key, locate('\\u0000', decode(full_key, 'ISO-8859-1')) + 1)")).otherwise(F.col("full_key"))
    return raw.select(F.col("offset").alias("seq"), bucket.alias("bucket"), key.alias("user_key"), "full_key", "op", "value")
