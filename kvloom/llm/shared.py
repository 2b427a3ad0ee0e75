"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from kvloom.sources.files import delete, exists
from kvloom.sources.files import shared_folder as folder


class _Open(threading.local):
    """Paths of tables that this thread's open scratch() blocks have written, the innermost block last."""

    def __init__(self) -> None:
        self.blocks: list[list[str]] = []


_open = _Open()
#: Shuffle files of a write are of no use once its table is there.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """df as a table of the shared folder: it is computed once, and lost executors don't take it along.

    The write's shuffle files go when it ends. Within scratch() the table goes with the block; with `keep` it outlives that block
    and belongs to the next one around it, if there is one.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _without_leftovers(spark):
        df.write.option("compression", codec).parquet(path)
    within(path, keep)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, codec: str = "zstd") -> DataFrame:
    """As written(), with rows of one key in one file bucket: joins and groups by the key read it without a shuffle.

    It has as many buckets as the session has shuffle partitions. Spark keeps bucketing in its catalogue, so the table has a
    name there while its scratch() block lasts.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{folder(spark)}/{table}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with _without_leftovers(spark):
        df.write.bucketBy(buckets, key).option("compression", codec).option("path", path).saveAsTable(table)
    within(f"table {table}")
    within(path)
    return spark.table(table)


@contextlib.contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def within(path: str, keep: bool = False) -> None:
    """The path belongs to the innermost scratch() block, or with `keep` to the one around it."""
    if len(_open.blocks) > keep:
        _open.blocks[-1 - keep].append(path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """A block whose tables are deleted at its end, also when it fails. What is returned must not read them: write it with `keep`."""
    paths: list[str] = []
    _open.blocks.append(paths)
    try:
        yield
    finally:
        _open.blocks.pop()
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        for path in paths:
            if path.startswith("table "):
                spark.sql(f"DROP TABLE IF EXISTS `{path[6:]}`")
            else:
                delete(spark, path)


def fresh(taken: list[str], name: str) -> str:
    """A column name like `name` that is none of those taken, in any case of letters."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name
