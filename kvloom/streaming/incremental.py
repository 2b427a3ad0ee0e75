"""The fold over a stream of log records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kvloom.operators.fold import last_records, latest
from kvloom.operators.log import KVLOG
from kvloom.sources import files


def fold_available(log: DataFrame, folder: str) -> DataFrame:
    """The state after all input that is there, for catch-up runs; another run with the same folder goes on from there.

    Each micro-batch leaves the last records of its keys, tombstones included, in a directory of its own, which a repeated batch
    replaces. Folding these is the same as folding the stream. No state stays in memory, and nothing comes to the driver.
    """
    spark = log.sparkSession
    state = f"{folder}/state"

    def merge(batch: DataFrame, number: int) -> None:
        last_records(batch).select(*KVLOG.names).write.mode("overwrite").parquet(f"{state}/batch={number}")

    query = log.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if not files.exists(spark, state):
        return latest(spark.createDataFrame([], KVLOG))
    return latest(spark.read.schema(KVLOG).option("basePath", state).parquet(state).select(*KVLOG.names))
