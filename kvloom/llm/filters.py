"""Hashed sets of a bounded size, to drop rows before a join moves them. What passes by chance is dropped by the join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a key, and the least and the most bits of a filter (32 MB). Beyond some 30 million keys a filter is fuller and lets more rows through.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 28


def _bit(key: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size)).alias("bit")


def of(keys: DataFrame, column: str) -> np.ndarray:
    """A hashed set of keys, as bytes of bits: 64 bits come to the driver a row, so at most MOST_BITS / 8 bytes do."""
    wanted = BITS_A_KEY * keys.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, wanted - 1).bit_length()))
    bits = keys.select(_bit(F.col(column), size))
    words = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    out = np.zeros(size // 64, np.int64)
    table = words.toArrow()
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return out.view(np.uint8)


def passes(df: DataFrame, key: str, chosen: np.ndarray) -> DataFrame:
    """Rows whose key may be in the filter."""
    packed = df.sparkSession.sparkContext.broadcast(chosen)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = packed.value
        for batch in batches:
            bit = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            ok = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(ok.astype(bool)))

    with_bit = df.withColumn("bit", _bit(F.col(key), 8 * len(chosen)))
    return with_bit.mapInArrow(rows, with_bit.schema).drop("bit")
