"""Token counts of documents in flat, unindexed token files, by a scan for the end-of-document id.

A file is ids of two or four bytes, one after the other; nothing says where documents begin. Spark deals files to tasks by byte
ranges. A task finds the end id in its range with vectorised comparisons, block by block, at every byte, as it can't know yet
where its range begins in the file. A prefix scan over one small row a range, and over one a block, then says where each begins,
which finds stand on an id's border, how many documents ended before, and where the last of them did.

Ranges are read as lines that end in a byte of no further meaning: Spark's reader knows how to cut files of any store at line
ends, and what is cut off is put back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kvloom.llm import shared
from kvloom.llm import text as T
from kvloom.llm.tokens import word_ids

#: Bytes that are searched at once.
BLOCK_BYTES = 1 << 20
#: Bytes of text whose ids are made together; a longer document is a block of its own.
TEXT_BYTES = 3 << 20
#: Documents whose ids are listed in one row beside the token files.
LISTED = 1000
#: Bytes that readers take for a mark of the encoding, and drop, where a file begins with them.
MARK = b"\xef\xbb\xbf"
FOUND = "file string, file_size long, at long, part long, n_bytes long, ends array<long>"


def end_bytes(end_id: int, id_bytes: int) -> bytes:
    """The end id as it stands in a file. The greatest id of that width stands for end ids within texts, so it can't be the end id."""
    if id_bytes not in (2, 4) or not 0 <= end_id < inner_id(id_bytes):
        raise ValueError("ids have two or four bytes, and the end id must be below the greatest of them")
    out = end_id.to_bytes(id_bytes, "little")
    if out.startswith(MARK[:2]):
        raise ValueError("an end id that begins like a byte-order mark can't be told from one")
    return out


def inner_id(id_bytes: int) -> int:
    """Stands in a file for an end id that a text itself gives (a literal end marker), so that it is no separator; no id of a vocabulary."""
    return (1 << 8 * id_bytes) - 1


def write_flat(docs: DataFrame, path: str, end_id: int, folder: str, id_bytes: int = 2) -> DataFrame:
    """Documents as flat token files under folder/kind=tokens, one for each task, and beside them which document is which: (file, number, doc_id).

    The scan doesn't read the latter. Files hold each document's ids and the end id after them, and nothing else. An end id within
    a text is written as inner_id(), one id for one. A vocabulary that doesn't fit the width is refused.
    """
    end, inner = end_bytes(end_id, id_bytes), inner_id(id_bytes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number = TaskContext.get().partitionId(), 0
        encoder = word_ids(path)
        for batch in batches:
            for b in T.blocks(batch.column(1), TEXT_BYTES):
                ids, offsets = encoder.block(b)
                if len(ids) and ids.max() >= inner:
                    raise ValueError(f"the vocabulary has ids that don't fit {id_bytes} bytes")
                data = memoryview(np.where(ids == end_id, inner, ids).astype(f"<u{id_bytes}").tobytes())
                edges = (offsets * id_bytes).tolist()
                yield _made("tokens", file, range(number, number + b.n), [bytes(data[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)])
                doc_ids = ["" if x is None else str(x) for x in batch.column(0).slice(b.first, b.n).to_pylist()]
                firsts = range(0, b.n, LISTED)
                yield _made("order", file, [number + i for i in firsts], [f"{number + i}:{','.join(doc_ids[i : i + LISTED])}".encode() for i in firsts])
                number += b.n
        encoder.forget()

    made = docs.select("doc_id", "text").mapInArrow(rows, "kind string, file long, number long, value binary")
    placed = made.sortWithinPartitions("kind", "file", "number").select("kind", "file", F.col("value").cast("string").alias("value"))
    # the writer's line end is the end id: it follows each document
    lines = {"lineSep": end.decode("iso-8859-1"), "encoding": "ISO-8859-1"}
    placed.write.partitionBy("kind", "file").options(**lines, maxRecordsPerFile=0, compression="none").text(folder)
    spark, listed = docs.sparkSession, f"{folder}/kind=order"
    if not shared.exists(spark, listed):  # no documents
        return spark.createDataFrame([], "file long, number long, doc_id long")
    file_of = F.regexp_extract("_metadata.file_path", r"/file=(\d+)/", 1).cast("long")
    parts = spark.read.options(**lines, recursiveFileLookup=True).text(listed).select(file_of.alias("file"), F.split("value", ":").alias("v"))
    parts = parts.select("file", F.col("v")[0].cast("long").alias("first"), F.posexplode(F.split(F.col("v")[1], ",")).alias("i", "doc"))
    return parts.select("file", (F.col("first") + F.col("i")).alias("number"), F.when(F.col("doc") != "", F.col("doc")).cast("long").alias("doc_id"))


def _made(kind: str, file: int, numbers, values: list[bytes]) -> pa.RecordBatch:
    n = len(values)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array([file] * n, pa.int64()), pa.array(list(numbers), pa.int64()), pa.array(values, pa.binary())], names=["kind", "file", "number", "value"])


def _scan(end: bytes, line_end: bytes, block_bytes: int):
    """Finds of the end id at every byte of ranges that come as lines (file, file_size, at, line), in blocks."""
    wide = len(end)

    def found(file: str, file_size: int, at: int, part: int, begin: int, carry: bytes, new: bytes) -> pa.RecordBatch:
        data = np.frombuffer(carry + new, np.uint8)
        hit = np.ones(max(len(data) - wide + 1, 0), bool)
        for i, b in enumerate(end):
            hit &= data[i : i + len(hit)] == b
        ends = np.flatnonzero(hit) + (begin - len(carry))
        columns = [pa.array([file]), pa.array([file_size], pa.int64()), pa.array([at], pa.int64()), pa.array([part], pa.int64()), pa.array([len(new)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, part, begin, carry = None, 0, 0, b""
        for batch in batches:
            files, sizes, ats = (batch.column(c).to_pylist() for c in ("file", "file_size", "at"))
            cuts = [0, *(i for i in range(1, batch.num_rows) if ats[i] != ats[i - 1] or files[i] != files[i - 1]), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if here != (files[i], ats[i]):
                    here, part, begin, carry = (files[i], ats[i]), 0, 0, b""
                lines = batch.column("line").slice(i, j - i).cast(pa.large_binary())
                whole = pc.binary_join_element_wise(lines, pa.scalar(b"", pa.large_binary()), pa.scalar(line_end, pa.large_binary()))
                _, _, data = whole.buffers()
                edges = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
                data = memoryview(data)[edges[0] : edges[-1]]
                for k in range(0, len(data), block_bytes):
                    new = bytes(data[k : k + block_bytes])
                    yield found(*here[:1], sizes[i], here[1], part, begin, carry, new)
                    part, begin, carry = part + 1, begin + len(new), (carry + new)[-(wide - 1) :]

    return rows


def token_counts(spark: SparkSession, path: str, end_id: int, id_bytes: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, number, start, n_tokens, ended): the documents of all flat files under a path that Spark can read.

    start is the place of a document's first id in its file; n_tokens leaves the end id out. Ids after the last end are a document
    that has not ended, if there are any. An empty document (two ends in turn) counts 0. A file may be of any size: no task reads
    more than a byte range of it, and what is scanned in turn is a row a range, or a row a block of a range. Bytes after a file's
    last whole id count for nothing. An empty file, or none at all, gives no rows.
    """
    end = end_bytes(end_id, id_bytes)
    # any byte will do that can't stand in an end id across two ranges
    line_end = next(bytes([b]) for b in b"\n\x0b\x0c\x0e\x0f" if b not in end[:-1])
    lines = spark.read.option("lineSep", line_end.decode()).option("recursiveFileLookup", "true").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("line"))
    blocks = shared.written(lines.mapInArrow(_scan(end, line_end, block_bytes), FOUND), "ends")

    ranges = blocks.groupBy("file", "at").agg(F.sum("n_bytes").alias("bytes"), F.max("file_size").alias("file_size"))
    in_file = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    read = F.sum("bytes").over(W.partitionBy("file"))  # one line end more than there is, where the file doesn't end in one
    dropped = F.when(F.col("file_size") - read >= len(MARK) - 1, len(MARK)).otherwise(0)
    ranges = ranges.select("file", "at", (F.coalesce(F.sum("bytes").over(in_file), F.lit(0)) + dropped).alias("offset"))
    place = f"filter(transform(ends, e -> e + offset), e -> e % {id_bytes} = 0 AND e + {id_bytes} <= file_size)"
    placed = blocks.join(ranges, ["file", "at"]).select("file", "file_size", "at", "part", F.expr(f"transform({place}, e -> cast(e / {id_bytes} as bigint))").alias("ends"))
    placed = shared.written(placed.withColumn("n", F.size("ends").cast("long")).withColumn("past", F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1)), "placed")

    sums = placed.groupBy("file", "at").agg(F.sum("n").alias("n"), F.max("past").alias("past"))
    sums = sums.select("file", "at", F.coalesce(F.sum("n").over(in_file), F.lit(0)).alias("n_before"), F.coalesce(F.max("past").over(in_file), F.lit(0)).alias("past_before"))
    in_range = W.partitionBy("file", "at").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    stitched = placed.withColumn("n_in", F.coalesce(F.sum("n").over(in_range), F.lit(0))).withColumn("past_in", F.max("past").over(in_range)).join(sums, ["file", "at"])
    stitched = stitched.select("file", "ends", (F.col("n_in") + F.col("n_before")).alias("number"), F.coalesce("past_in", "past_before").alias("from"))
    ended = stitched.select("file", "number", "from", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("from")).otherwise(F.element_at("ends", F.greatest("i", F.lit(1))) + 1)
    ended = ended.select("file", (F.col("number") + F.col("i")).alias("number"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = placed.groupBy("file").agg(F.sum("n").alias("number"), F.coalesce(F.max("past"), F.lit(0)).alias("start"), F.floor(F.max("file_size") / id_bytes).alias("size"))
    rest = whole.filter(F.col("size") > F.col("start")).select("file", "number", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def counts_of_documents(docs: DataFrame, path: str, end_id: int, id_bytes: int = 2) -> DataFrame:
    """doc_id, file, number, start, n_tokens of documents written as flat files and scanned.

    A null or empty text counts 0; repeated rows, and rows with a null doc_id, count each. A very long text spans blocks and
    ranges. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with shared.scratch():
        folder = f"{shared.folder(spark)}/flat-{uuid.uuid4().hex}"
        shared.within(folder)
        order = write_flat(docs, path, end_id, folder, id_bytes)
        tokens = f"{folder}/kind=tokens"
        if not shared.exists(spark, tokens):
            return spark.createDataFrame([], "doc_id long, file long, number long, start long, n_tokens long")
        counts = token_counts(spark, tokens, end_id, id_bytes)
        counts = counts.withColumn("file", F.regexp_extract("file", r"/file=(\d+)/", 1).cast("long"))
        done = order.join(counts, ["file", "number"]).select("doc_id", "file", "number", "start", "n_tokens")
        return shared.written(done, "counts", keep=True)
