"""Bloom filters as data: positions, words, probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bit_positions, little_endian


def build(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """position: the set bits, each once; duplicates meet before the shuffle."""
    return keys.select(F.explode(bit_positions(F.col("key"), bits, hashes)).alias("position")).distinct()


def words(positions: DataFrame) -> DataFrame:
    """word, bits: the non-zero 64-bit words of the filter, as signed longs."""
    return positions.groupBy(F.floor(F.col("position") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(position % 64 as int))")).alias("bits"))


def image(positions: DataFrame, bits: int, hashes: int) -> DataFrame:
    """One row: the filter's file image, its bits and hashes and then all words, little-endian."""
    every = positions.sparkSession.range(-(-bits // 64)).withColumnRenamed("id", "word")
    # A negative word, with its top bit set, needs no sign: the shifts fill with zeros.
    filled = every.join(words(positions), "word", "left").select("word", F.hex(little_endian(F.coalesce("bits", F.lit(0).cast("long")), 8)).alias("hex"))
    body = filled.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "hex"))), lambda x: x["hex"]), "").alias("hex"))
    head = [little_endian(F.lit(n).cast("long"), 8) for n in (bits, hashes)]
    return body.select(F.concat(*head, F.unhex("hex")).alias("image"))


def probe(probes: DataFrame, positions: DataFrame, bits: int, hashes: int) -> DataFrame:
    """probes with `maybe`: whether all positions of the key are set."""
    asked = probes.select("key").distinct().select("key", F.explode(F.array_distinct(bit_positions(F.col("key"), bits, hashes))).alias("position"))
    hits = asked.join(positions.withColumn("set", F.lit(1)), "position", "left").groupBy("key").agg((F.count("*") == F.count("set")).alias("maybe"))
    return probes.join(hits, "key")
