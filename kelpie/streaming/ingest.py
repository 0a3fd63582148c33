"""Structured Streaming over a change log: append to a store, or keep the latest values by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.reads import newest
from ..schema import VALUE
from ..sources.files import Files
from ..store import Store

#: Micro-batches after which the view's changes are merged into a new whole.
MERGE_EVERY = 8


def stream_into(store: Store, ops: DataFrame, checkpoint: str, name: str = "stream"):
    """Writes each micro-batch of a streaming frame (op_idx, op, key, value) as one batch of the store.

    Returns the started query; it takes what is there and ends. The store knows the last micro-batch of each stream name,
    so one that is run again after a failure is not applied twice.
    """

    def append(batch: DataFrame, number: int) -> None:
        if not store.write_frame(batch, (name, number)):
            raise OSError("the store refused a batch")

    return ops.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, target: str, batches: int) -> list[str]:
    """The last whole and the changes after it, of the first so many micro-batches."""
    names = Files(spark).names(target)
    wholes = [n for n in (int(x[6:]) for x in names if x.startswith("whole_") and x[6:].isdigit()) if n < batches]
    last = max(wholes, default=-1)
    changes = sorted(n for n in (int(x[7:]) for x in names if x.startswith("change_") and x[7:].isdigit()) if last < n < batches)
    return [f"{target}/whole_{last}"] * (last >= 0) + [f"{target}/change_{n}" for n in changes]


def latest_view(log: DataFrame, target: str, checkpoint: str, every: int = MERGE_EVERY):
    """Maintains the newest version of each key of a streaming log (key, seq, type, value) in a folder.

    A micro-batch is reduced to a row a key and written as a change; every so many, the changes and the last whole are
    merged into a new whole, and what is behind it goes. A batch that is run again writes the same files once more.
    """
    spark, files = log.sparkSession, Files(log.sparkSession)

    def merge(batch: DataFrame, number: int) -> None:
        newest(batch.select("key", "seq", "type", "value")).write.mode("overwrite").parquet(f"{target}/change_{number}")
        if (number + 1) % every == 0:
            old = _parts(spark, target, number + 1)
            if old == [f"{target}/whole_{number}"]:
                return
            newest(spark.read.parquet(*old)).write.mode("overwrite").parquet(f"{target}/.new_{number}")
            files.rename(f"{target}/.new_{number}", f"{target}/whole_{number}")
            for path in old:
                files.delete(path)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_view(spark: SparkSession, target: str, batches: int) -> DataFrame:
    """Visible rows of the view after so many micro-batches, no fewer than its last whole has."""
    return newest(spark.read.parquet(*_parts(spark, target, batches))).where(f"type = {VALUE}")
