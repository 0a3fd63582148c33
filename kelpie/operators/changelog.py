"""Building the change log: operations to sequenced records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TOMBSTONE, VALUE


def assign_sequence(ops: DataFrame, last_seq: int, block: int = 1_000_000) -> DataFrame:
    """ops (op_idx unique, op put/remove, key, value) as records (key, seq, type, value), seq from last_seq + 1 in order.

    Ranks are counted within blocks of op_idx and blocks are offset by the rows before them, so no task sorts the batch.
    """
    dealt = ops.withColumn("block", F.floor(F.col("op_idx") / block))
    sizes = dealt.groupBy("block").agg(F.count("*").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block only
    base = sizes.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("block").orderBy("op_idx")
    removed = F.col("op") == "remove"
    return (
        dealt.withColumn("nth", F.row_number().over(own))
        .join(base, "block")
        .select(
            "key",
            (F.col("base") + F.col("nth") + last_seq).cast("long").alias("seq"),
            F.when(removed, TOMBSTONE).otherwise(VALUE).cast("tinyint").alias("type"),
            F.when(removed, F.lit("").cast(ops.schema["value"].dataType)).otherwise(F.col("value")).alias("value"),
        )
    )


def last_write_wins(records: DataFrame, arrival: str) -> DataFrame:
    """One record for each (key, seq): the one that arrived last."""
    w = Window.partitionBy("key", "seq").orderBy(F.desc(arrival))
    return records.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", arrival)


def tail_statistics(records: DataFrame) -> DataFrame:
    """Rows, bytes and greatest sequence of an unflushed tail."""
    from ..functions.scalars import entry_size

    return records.agg(F.count("*").alias("entries"), F.coalesce(F.sum(entry_size()), F.lit(0)).alias("bytes"), F.coalesce(F.max("seq"), F.lit(0)).alias("max_seq"))
