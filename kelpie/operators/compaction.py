"""Version garbage collection and the choice of what to compact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retain(log: DataFrame, oldest: int) -> DataFrame:
    """Versions that some reader at `oldest` or later can see: all newer than it and the newest one up to it of each key;
    tombstones stay."""
    w = Window.partitionBy("key", F.col("seq") > oldest).orderBy(F.desc("seq"))
    return log.withColumn("nth", F.row_number().over(w)).where((F.col("seq") > oldest) | (F.col("nth") == 1)).drop("nth")


def level_sizes(tables: DataFrame, base_bytes: int) -> DataFrame:
    """Bytes and budget (base * 10**(level - 1), from level 1) of each level."""
    sizes = tables.groupBy("level").agg(F.count("*").alias("tables"), F.sum("size").alias("size"))
    budget = F.when(F.col("level") >= 1, (F.lit(base_bytes) * F.pow(F.lit(10), F.col("level") - 1)).cast("long"))
    return sizes.withColumn("budget", budget).withColumn("over", F.coalesce(F.col("size") > F.col("budget"), F.lit(False)))


def level_zero_inputs(tables: DataFrame) -> DataFrame:
    """All tables of level 0 and those of level 1 that meet their common hull, gaps included."""
    hull = tables.where("level = 0").agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi")).where("lo is not null")
    ones = tables.where("level = 1").join(F.broadcast(hull), (F.col("min_key") <= F.col("hi")) & (F.col("max_key") >= F.col("lo"))).drop("lo", "hi")  # one row
    return tables.where("level = 0").unionByName(ones)


def next_table(tables: DataFrame, level: int, cursor) -> DataFrame:
    """The level's first table that starts after the cursor, else its first table."""
    ranked = tables.where(F.col("level") == level)
    after = F.lit(False) if cursor is None else F.col("min_key") > F.lit(cursor)
    return ranked.orderBy(F.when(after, 0).otherwise(1), "min_key").limit(1)


def overlapping(tables: DataFrame, chosen: DataFrame, level: int) -> DataFrame:
    """Tables of a level that share a key with a chosen table's closed range."""
    from ..plans.manifest import overlaps

    own = tables.where(F.col("level") == level)
    hits = overlaps(chosen, own).select(F.col("right_number").alias("number")).distinct()
    return own.join(hits, "number", "left_semi").select(*tables.columns)


def first_over_budget(tables: DataFrame, base_bytes: int) -> DataFrame:
    """No or one row: the first level whose bytes exceed its budget."""
    return level_sizes(tables, base_bytes).where("over").orderBy("level").limit(1).select("level", "size", "budget")
