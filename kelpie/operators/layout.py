"""Folds with reset: grouping ordered rows into runs that close once their bytes exceed a threshold.

A run depends on all rows before it, but only through the bytes carried over a block's edge. A block's map says, for any
bytes carried in, what it carries out and how many runs it closes: it is a step function, and as runs that start at
different rows soon close at the same ones, it has few steps. Maps of FAN blocks are composed into one, again and again,
until FAN are left; then the carried bytes go down the same tree, and each block is numbered on its own. All of it runs
on executors; no task holds more than a block or the maps of FAN blocks.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored

FAN = 256
#: Bytes of records in one block.
BLOCK_BYTES = 64 << 20


def closings(sizes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running bytes, and for a run that starts at each row (and the end): bytes carried out, runs closed by the end."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    close = np.searchsorted(total, total + threshold, "right")  # the row after the one that exceeds
    last, count = np.where(close <= n, close, np.arange(n + 1)), (close <= n).astype(np.int64)
    while True:  # twice as far each time
        further = last[last]
        if (further == last).all():
            return total, total[n] - total[last], count
        count, last = count + count[last], further


class Steps:
    """The map of a block: with c bytes carried in, the first step above threshold - c says what comes out."""

    def __init__(self, until: list[int], carry: list[int], runs: list[int], whole: int):
        self.until, self.carry, self.runs, self.whole = until, carry, runs, whole

    def after(self, carried: int, runs: int, threshold: int) -> tuple[int, int]:
        k = bisect_right(self.until, threshold - carried)
        return (self.carry[k], runs + self.runs[k]) if k < len(self.until) else (carried + self.whole, runs)


def _frame(block: int, steps: Steps) -> pd.DataFrame:
    """A step for each stretch of equal results, at its last place; a block that never closes has one without a place."""
    until, carry, runs = (np.array(x, np.int64) for x in (steps.until, steps.carry, steps.runs))
    keep = np.flatnonzero(np.r_[(carry[1:] != carry[:-1]) | (runs[1:] != runs[:-1]), True][: len(until)])
    rows = {"until": until[keep], "carry": carry[keep], "runs": runs[keep]} if len(until) else {"until": [-1], "carry": [0], "runs": [0]}
    return pd.DataFrame(rows).assign(block=block, whole=steps.whole)[list(MAP)]


MAP = {"block": "long", "until": "long", "carry": "long", "runs": "long", "whole": "long"}
MAP_SCHEMA = ", ".join(f"{k} {v}" for k, v in MAP.items())


def _maps(pdf: pd.DataFrame) -> list[tuple[int, Steps]]:
    out = []
    for block, g in pdf.sort_values(["block", "until"]).groupby("block", sort=True):
        g_ = g[g["until"] >= 0]
        out.append((int(block), Steps(g_["until"].tolist(), g_["carry"].tolist(), g_["runs"].tolist(), int(g["whole"].iloc[0]))))
    return out


def composed(maps: list[Steps], threshold: int) -> Steps:
    """One map of consecutive blocks."""
    until, carry, runs, before = [], [], [], 0
    for i, m in enumerate(maps):
        for u, c, r in zip(m.until, m.carry, m.runs, strict=True):
            for later in maps[i + 1 :]:
                c, r = later.after(c, r, threshold)
            until.append(before + u)
            carry.append(c)
            runs.append(r)
            if before + u > threshold:
                break
        before += m.whole
        if until and until[-1] > threshold:
            break
    return Steps(until, carry, runs, sum(m.whole for m in maps))


CARRIED = "block long, carried_in long, runs_before long, bytes_before long"


def _carried(maps: DataFrame, threshold: int) -> DataFrame:
    """block, carried_in, runs_before and bytes_before of every block of stored maps."""
    ends = maps.agg(F.min("block"), F.max("block")).first()
    group = F.expr(f"block div {FAN}")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        c, r, at = (int(pdf[k].iloc[0]) for k in ("carried_in", "runs_before", "bytes_before"))
        rows = []
        for block, m in _maps(pdf):
            rows.append((block, c, r, at))
            c, r = m.after(c, r, threshold)
            at += m.whole
        return pd.DataFrame(rows, columns=["block", "carried_in", "runs_before", "bytes_before"])

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _maps(pdf)
        return _frame(found[0][0] // FAN, composed([m for _, m in found], threshold))

    if ends[0] is None or ends[0] // FAN == ends[1] // FAN:
        begun = maps.withColumns({"carried_in": F.lit(0), "runs_before": F.lit(0), "bytes_before": F.lit(0)}).withColumn("of", group)
    else:
        above = _carried(stored(maps.groupBy(group.alias("of")).applyInPandas(up, MAP_SCHEMA)), threshold)
        begun = maps.withColumn("of", group).join(above.withColumnRenamed("block", "of"), "of")
    return begun.groupBy("of").applyInPandas(walk, CARRIED)


def fold(rows: DataFrame, block: str, order: list[str], size: str, threshold: int, descending: tuple[str, ...] = (), blocks: int | None = None) -> DataFrame:
    """rows with `run`, the number of the run (from 0) that each falls into, and `at`, the bytes before it.

    block: an integer column whose order agrees with the rows' and whose groups fit into a task. rows: the same in every
    job that reads them. blocks: how many there are, if known; a single one has nothing carried in.
    """
    ascending = [c not in descending for c in order]

    def ready(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(order, ascending=ascending, kind="stable")

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = ready(pdf)
        total, carry, count = closings(pdf[size].to_numpy(np.int64), threshold)
        # With c bytes carried in, the first close is after the first row that makes total > threshold - c.
        stop = min(len(pdf), int(np.searchsorted(total, threshold, "right")))
        at = slice(1, stop + 1)
        return _frame(int(pdf[block].iloc[0]), Steps(total[at].tolist(), carry[at].tolist(), (count[at] + 1).tolist(), int(total[-1])))

    if blocks == 1:
        begun = rows.withColumns({"of_block": F.col(block), **{c: F.lit(0) for c in ("carried_in", "runs_before", "bytes_before")}})
    else:
        maps = stored(rows.select(block, *order, size).groupBy(block).applyInPandas(summary, MAP_SCHEMA))
        begun = rows.join(_carried(maps, threshold).withColumnRenamed("block", "of_block"), F.col(block) == F.col("of_block"))

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = ready(pdf)
        sizes, out = pdf[size].to_numpy(np.int64), np.zeros(len(pdf), np.int64)
        bytes_, run, begun = (int(pdf[c].iloc[0]) for c in ("carried_in", "runs_before", "bytes_before"))
        total = np.concatenate([[0], np.cumsum(sizes)])
        i = 0
        while i < len(pdf):
            j = int(np.searchsorted(total, total[i] + threshold - bytes_, "right"))
            out[i : min(j, len(pdf))] = run
            i, bytes_, run = j, 0, run + 1
        return pdf.drop(columns=["of_block", "carried_in", "runs_before", "bytes_before"]).assign(run=out, at=begun + total[:-1])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", run long, at long"
    return begun.groupBy(block).applyInPandas(number, schema)


def ordered_blocks(rows: DataFrame, order: list[Column | str], size: str, block_bytes: int) -> tuple[DataFrame, int]:
    """rows with `block`, ranges in the given order of about block_bytes each, stored: Spark samples where they end; and
    how many there are."""
    n = int((rows.agg(F.sum(size)).first()[0] or 0) // block_bytes) + 1
    if n == 1:
        return rows.withColumn("block", F.lit(0).cast("long")), 1
    return stored(rows.repartitionByRange(n, *order).withColumn("block", F.spark_partition_id().cast("long"))), n


def flush_runs(log: DataFrame, threshold: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The log with `run`: which flush each record goes to, in sequence order."""
    from ..functions.scalars import entry_size

    rows, n = ordered_blocks(log.withColumn("bytes", entry_size()), ["seq"], "bytes", block_bytes)
    return fold(rows, "block", ["seq"], "bytes", threshold, blocks=n).drop("block", "bytes", "at")


def slices(log: DataFrame, threshold: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The log with `run`: which compaction output each record goes to; versions of a key stay together."""
    from ..functions.scalars import encoded_size

    sizes = log.groupBy("key").agg(F.sum(encoded_size()).alias("bytes"))
    # A block holds a row for each key; blocks of many small keys are bounded by their own bytes.
    rows, n = ordered_blocks(sizes.withColumn("held", F.octet_length("key") + 16), ["key"], "held", block_bytes)
    return log.join(fold(rows.drop("held"), "block", ["key"], "bytes", threshold, blocks=n).select("key", "run"), "key")


def index_blocks(log: DataFrame, threshold: int = 4096, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Sparse index of a sorted table: the first key and the byte offset of each block."""
    from ..functions.scalars import encoded_size

    rows, n = ordered_blocks(log.select("key", "seq", encoded_size().alias("bytes")), ["key", F.desc("seq")], "bytes", block_bytes)
    runs = fold(rows, "block", ["key", "seq"], "bytes", threshold, descending=("seq",), blocks=n)
    return runs.groupBy("run").agg(F.min_by("key", "at").alias("key"), F.min("at").alias("offset"))


def index_lookup(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Each probe key with the offset where a search for it begins: the last entry before it, else its own or none.

    Versions of a key may begin in the block of an earlier entry, so the search starts at the last entry with a smaller
    key. Entries and probes are put in one order, in ranges that carry the last entry over.
    """
    from pyspark.sql import Window

    entries = index.select("key", "offset", F.lit(1).alias("kind"))
    both = entries.unionByName(probes.select("key", F.lit(None).cast("long").alias("offset"), F.lit(0).alias("kind")).distinct())
    ranged = stored(both.repartitionByRange("key").withColumn("block", F.spark_partition_id()))
    ends = ranged.groupBy("block").agg(F.max("offset").alias("end"))  # a row for each range
    carried = ends.select("block", F.max("end").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    before = Window.partitionBy("block").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumn("found", F.max("offset").over(before)).join(F.broadcast(carried), "block").where("kind = 0")
    lowest = index.agg(F.min("key")).first()[0]
    return found.select("key", F.when(F.col("key") >= F.lit(lowest), F.coalesce("found", "carried", F.lit(0))).alias("offset"))


def index_faults(index: DataFrame, table_bytes: int) -> DataFrame:
    """Entries that break the index: not after the one before in key and offset, or beyond the table."""
    from pyspark.sql import Window

    ranged = stored(index.repartitionByRange("offset").withColumn("block", F.spark_partition_id()))
    ends = ranged.groupBy("block").agg(F.max(F.struct("offset", "key")).alias("end"))
    carried = ends.select("block", F.lag("end").over(Window.orderBy("block")).alias("carried"))  # a row for each range
    own = F.lag(F.struct("offset", "key")).over(Window.partitionBy("block").orderBy("offset"))
    found = ranged.withColumn("own", own).join(F.broadcast(carried), "block").withColumn("before", F.coalesce("own", "carried"))
    first = F.col("before").isNull() & (F.col("offset") != 0)
    return found.where(first | (F.col("offset") >= table_bytes) | (F.col("before.offset") >= F.col("offset")) | (F.col("before.key") > F.col("key"))).select("key", "offset")
