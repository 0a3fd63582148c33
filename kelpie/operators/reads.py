"""Reads of the change log: newest visible version of each key, at any sequence, for ranges and for probes.

Key and sequence predicates are applied below the top-1 and reach the Parquet scan; the record kind is tested above it,
since a tombstone has to hide what is older.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TOMBSTONE, VALUE


def at_sequence(log: DataFrame, read_seq: int | None) -> DataFrame:
    """The log as of read_seq; None is the present."""
    return log if read_seq is None else log.where(F.col("seq") <= read_seq)


def newest(log: DataFrame, read_seq: int | None = None, tie_break: list[Column] | None = None) -> DataFrame:
    """The newest version of each key, tombstones included. Spark limits groups to one row before the shuffle, too."""
    w = Window.partitionBy("key").orderBy(F.desc("seq"), *(tie_break or []))
    return at_sequence(log, read_seq).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def latest(log: DataFrame, read_seq: int | None = None) -> DataFrame:
    """The newest version of each key that is visible: keys whose newest version is a tombstone are absent."""
    return newest(log, read_seq).where(F.col("type") == VALUE)


def tombstones(log: DataFrame, read_seq: int | None = None) -> DataFrame:
    return newest(log, read_seq).where(F.col("type") == TOMBSTONE)


def in_range(log: DataFrame, start, end) -> DataFrame:
    """Keys in the half-open range; an empty end means an empty range."""
    return log.where((F.col("key") >= F.lit(start)) & (F.col("key") < F.lit(end)))


def scan(log: DataFrame, start, end, read_seq: int | None = None, ordered: bool = True) -> DataFrame:
    found = latest(in_range(log, start, end), read_seq)
    return found.orderBy("key") if ordered else found


def get(log: DataFrame, key, read_seq: int | None = None) -> DataFrame:
    """No or one row: the visible version of one key."""
    return at_sequence(log.where(F.col("key") == F.lit(key)), read_seq).orderBy(F.desc("seq")).limit(1).where(F.col("type") == VALUE)


def state(kind: Column) -> Column:
    return F.when(kind.isNull(), "ABSENT").when(kind == TOMBSTONE, "TOMBSTONE").otherwise("VALUE")


def multi_get(log: DataFrame, probes: DataFrame, read_seq: int | None = None) -> DataFrame:
    """Every probe key with its state VALUE, TOMBSTONE or ABSENT and the version found.

    The log is first reduced to the probes' keys; whether these are broadcast is decided by their size.
    """
    wanted = probes.select("key").distinct()
    found = newest(log.join(wanted, "key", "left_semi"), read_seq)
    joined = probes.join(found, "key", "left")
    return joined.withColumn("state", state(F.col("type"))).withColumn("value", F.when(F.col("state") == "VALUE", F.col("value")))


def as_of(log: DataFrame, probes: DataFrame, probe_id: str) -> DataFrame:
    """Each probe (probe_id, key, read_seq) with the newest version of its key at or before its own read_seq.

    Probes are put among the versions in sequence order and take the last version before them, so the cost is a sort of
    both and not probes times versions.
    """
    empty = lambda name: F.lit(None).cast(log.schema[name].dataType).alias(name)
    versions = log.select("key", F.col("seq").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast(probes.schema[probe_id].dataType).alias(probe_id), "seq", "type", "value")
    asks = probes.select("key", F.coalesce("read_seq", F.lit(2**63 - 1)).alias("at"), F.lit(1).alias("asks"), probe_id, empty("seq"), empty("type"), empty("value"))
    w = Window.partitionBy("key").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = versions.unionByName(asks).withColumn("hit", F.last(F.when(F.col("asks") == 0, F.struct("seq", "type", "value")), ignorenulls=True).over(w)).where("asks = 1")
    kind = F.col("hit.type")
    return found.select(probe_id, "key", state(kind).alias("state"), F.when(kind == VALUE, F.col("hit.seq")).alias("seq"), F.when(kind == VALUE, F.col("hit.value")).alias("value"))


def merge(sources: list[DataFrame]) -> DataFrame:
    """All versions of all sources in table order: key, then newest first."""
    return reduce(DataFrame.unionByName, sources).orderBy("key", F.desc("seq"))


def history(log: DataFrame) -> DataFrame:
    """Every version with its number (1 is the newest) and the sequence that replaced it."""
    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    return log.withColumn("version", F.row_number().over(w).cast("long")).withColumn("replaced_at", F.lag("seq").over(w))
