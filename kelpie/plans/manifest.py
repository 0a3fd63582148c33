"""The manifest: which table files are live, their levels and key ranges, and the plans that prune by them.

A manifest is one small JSON file for each version, published by a rename; readers take the highest version, so a
failure before the rename leaves the former one in force. It holds a line for each table file, not for each record.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import TABLE_META
from ..sources.files import Files, stored

FORMAT = 4


@dataclass(frozen=True)
class Table:
    number: int
    level: int
    size: int
    min_key: bytes
    max_key: bytes

    def overlaps(self, lo: bytes, hi: bytes) -> bool:
        """Closed ranges."""
        return self.min_key <= hi and self.max_key >= lo

    def meets_scan(self, start: bytes, end: bytes) -> bool:
        """A closed range against a half-open one."""
        return self.max_key >= start and self.min_key < end


@dataclass(frozen=True)
class Manifest:
    log_number: int = 0
    next_number: int = 0
    last_seq: int = 0
    tables: tuple[Table, ...] = field(default=())
    #: The last batch of each stream that is in the tables.
    streams: tuple[tuple[str, int], ...] = field(default=())

    def level(self, n: int) -> list[Table]:
        """Level 0 newest first; others by smallest key. Empty beyond the last level."""
        found = [t for t in self.tables if t.level == n]
        return sorted(found, key=lambda t: -t.number) if n == 0 else sorted(found, key=lambda t: t.min_key)

    def level_count(self) -> int:
        return max((t.level + 1 for t in self.tables), default=0)

    def numbers(self) -> list[int]:
        return sorted((t.number for t in self.tables), reverse=True)

    def allocate(self) -> tuple[Manifest, int]:
        return replace(self, next_number=self.next_number + 1), self.next_number

    def table_for(self, level: int, key: bytes) -> Table | None:
        if level == 0:
            raise ValueError("tables of level 0 overlap")
        return next((t for t in self.level(level) if t.min_key <= key <= t.max_key), None)

    def add(self, table: Table) -> Manifest:
        if table.level and any(t.overlaps(table.min_key, table.max_key) for t in self.level(table.level)):
            raise ValueError("the table's keys meet those of another one of its level")
        return replace(self, tables=(*self.tables, table))

    def swap(self, removed: set[int], added: list[Table]) -> Manifest:
        out = replace(self, tables=tuple(t for t in self.tables if t.number not in removed))
        for t in added:
            out = out.add(t)
        return out

    def for_scan(self, start: bytes, end: bytes) -> list[Table]:
        return [t for t in self.tables if t.meets_scan(start, end)]

    def for_keys(self, lo: bytes, hi: bytes) -> list[Table]:
        return [t for t in self.tables if t.overlaps(lo, hi)]

    def for_key(self, key: bytes) -> list[Table]:
        return [t for t in self.tables if t.min_key <= key <= t.max_key]

    def to_json(self) -> str:
        text = lambda b: base64.b64encode(b).decode()
        tables = [{"number": t.number, "level": t.level, "size": t.size, "min_key": text(t.min_key), "max_key": text(t.max_key)} for t in self.tables]
        return json.dumps({"version": FORMAT, "log_number": self.log_number, "next_number": self.next_number, "last_seq": self.last_seq, "tables": tables, "streams": dict(self.streams)})

    @staticmethod
    def from_json(text: str) -> Manifest:
        x = json.loads(text)
        if x["version"] != FORMAT:
            raise ValueError(f"manifest version {x['version']} is not {FORMAT}")
        tables = tuple(Table(t["number"], t["level"], t["size"], base64.b64decode(t["min_key"]), base64.b64decode(t["max_key"])) for t in x["tables"])
        return Manifest(x["log_number"], x["next_number"], x["last_seq"], tables, tuple(sorted(x.get("streams", {}).items())))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t.number, t.level, t.size, bytearray(t.min_key), bytearray(t.max_key)) for t in self.tables], TABLE_META)


class ManifestStore:
    """Versions of the manifest in a folder of any file system that Spark reaches."""

    def __init__(self, files: Files, folder: str):
        self.files, self.folder = files, folder

    def _versions(self) -> list[int]:
        names = [n for n in self.files.names(self.folder) if n.startswith("manifest_") and n.endswith(".json")]
        return sorted(int(n[9:-5]) for n in names if n[9:-5].isdigit())

    def load(self) -> tuple[Manifest, int]:
        found = self._versions()
        if not found:
            return Manifest(), 0
        return Manifest.from_json(self.files.read_text(f"{self.folder}/manifest_{found[-1]}.json")), found[-1]

    def save(self, manifest: Manifest, after: int) -> int:
        """Publishes the version after `after`; fails if another writer already did."""
        path = f"{self.folder}/manifest_{after + 1}.json"
        if self.files.exists(path):
            raise FileExistsError(path)
        self.files.write_text(path, manifest.to_json())
        for old in self._versions():
            if old < after:
                self.files.delete(f"{self.folder}/manifest_{old}.json")
        return after + 1


# ---- the same choices as DataFrame plans ---------------------------------------------------------------------------


def table_meta(records: DataFrame, group: str, size) -> DataFrame:
    """What a manifest says of each group of records that become a table."""
    return records.groupBy(F.col(group).alias("number")).agg(
        F.count("*").alias("records"), F.sum(size).alias("size"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")
    )


#: Tables of a level whose bounds are sent to the tasks; a larger level is joined.
SENT_TABLES = 200_000


def _bounds(tables: DataFrame) -> list[tuple] | None:
    """Sorted (min_key, max_key, number), if they are few enough."""
    level = tables.select("min_key", "max_key", "number")
    if level.limit(SENT_TABLES + 1).count() > SENT_TABLES:
        return None
    return sorted((r["min_key"], r["max_key"], r["number"]) for r in level.collect())


def key_to_table(keys: DataFrame, tables: DataFrame) -> DataFrame:
    """keys with the number of the table of one disjoint level that contains each, null in gaps.

    Up to SENT_TABLES tables go to the tasks, where a key is found by bisection: no shuffle, and no comparison of every
    key with every table. Beyond, keys and tables are sorted together and a key takes the last table that starts before.
    """
    from bisect import bisect_right

    import pyarrow as pa

    level = _bounds(tables)
    if level is None:
        return _sorted_containment(keys, tables)
    starts = [t[0] for t in level]

    def run(batches):
        for b in batches:
            found = []
            for key in b.column("key").to_pylist():
                at = -1 if key is None else bisect_right(starts, key) - 1
                found.append(level[at][2] if at >= 0 and key <= level[at][1] else None)
            yield pa.record_batch([b.column("key"), pa.array(found, pa.int64())], ["key", "number"])

    return keys.select("key").mapInArrow(run, f"key {keys.schema['key'].dataType.simpleString()}, number long")


def _sorted_containment(keys: DataFrame, tables: DataFrame) -> DataFrame:
    """Ranges of keys hold their tables and keys in order; the last table of the ranges before is carried over."""
    hit = F.struct(F.col("min_key"), F.col("max_key"), F.col("number"))
    both = tables.select(F.col("min_key").alias("key"), F.lit(0).alias("asks"), hit.alias("hit")).unionByName(keys.select("key", F.lit(1).alias("asks")), allowMissingColumns=True)
    ranged = stored(both.repartitionByRange("key").withColumn("block", F.spark_partition_id()))
    last = ranged.groupBy("block").agg(F.max("hit").alias("last"))
    carried = last.select("block", F.max("last").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))  # a row for each range
    own = F.max("hit").over(Window.partitionBy("block").orderBy("key", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = ranged.withColumn("own", own).join(F.broadcast(carried), "block").where("asks = 1").withColumn("found", F.coalesce("own", "carried"))
    return found.select("key", F.when(F.col("key") <= F.col("found.max_key"), F.col("found.number")).alias("number"))


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of tables (closed key ranges) of two levels that share a key.

    Right tables are sorted by their smallest key; those that a left one meets stand in a row if their level is disjoint,
    and bisection finds it. A right side above SENT_TABLES is joined by range instead.
    """
    from bisect import bisect_left, bisect_right
    from itertools import accumulate

    import pyarrow as pa

    level = _bounds(right)
    if level is None:
        a = left.select(F.col("number").alias("left_number"), F.col("min_key").alias("left_min"), F.col("max_key").alias("left_max"))
        b = right.select(F.col("number").alias("right_number"), F.col("min_key").alias("right_min"), F.col("max_key").alias("right_max"))
        return a.join(b, (F.col("left_min") <= F.col("right_max")) & (F.col("left_max") >= F.col("right_min"))).select("left_number", "right_number")
    starts, reach = [t[0] for t in level], list(accumulate((t[1] for t in level), max))

    def run(batches):
        for b in batches:
            rows = []
            for number, lo, hi in zip(*(b.column(c).to_pylist() for c in ("number", "min_key", "max_key")), strict=True):
                rows += [(number, t[2]) for t in level[bisect_left(reach, lo) : bisect_right(starts, hi)] if t[1] >= lo]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["left_number", "right_number"])

    return left.select("number", "min_key", "max_key").mapInArrow(run, "left_number long, right_number long")


def level_faults(tables: DataFrame) -> DataFrame:
    """number and level of tables that start within the one before them in a level that has to be disjoint."""
    w = Window.partitionBy("level").orderBy("min_key", "number").rowsBetween(Window.unboundedPreceding, -1)
    return tables.where("level > 0").withColumn("reach", F.max("max_key").over(w)).where("min_key <= reach").select("number", "level")


def replace_tables(tables: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    return tables.join(removed, "number", "left_anti").unionByName(added)
