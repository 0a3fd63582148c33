"""The store: a versioned key-value table in a folder.

    folder/manifest/manifest_<n>.json   which tables are live
    folder/log/log_<n>/batch_<seq>      Parquet of each batch since the last flush, the unflushed tail
    folder/tables/table_<n>             Parquet of each sorted table, rows by key and newest first

Batches and tables are written beside their place and renamed into it; a manifest version publishes a flush or a
compaction at once, and reads follow the manifest alone, so what a failed writer left behind is never seen. There is one
writer. Batch interfaces (`write`, `write_frame`, `multi_get`) are meant for volume, `put` and `get` are sugar.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import entry_size
from .operators import compaction, layout, reads
from .operators.changelog import assign_sequence
from .plans.manifest import Manifest, ManifestStore, Table
from .schema import OPERATION, RECORD, TOMBSTONE, VALUE
from .sources.files import Files


class Batch:
    """Ordered puts and removes; writing does not use it up."""

    def __init__(self):
        self.rows: list[tuple[str, bytes, bytes]] = []

    def put(self, key: bytes, value: bytes) -> Batch:
        self.rows.append(("put", key, value))
        return self

    def remove(self, key: bytes) -> Batch:
        self.rows.append(("remove", key, b""))
        return self

    def clear(self) -> None:
        self.rows.clear()


class Snapshot:
    """A pinned sequence: versions that it sees outlive compaction until it is closed."""

    def __init__(self, pins: Counter, seq: int):
        self._pins, self.seq, self._open = pins, seq, True
        pins[seq] += 1

    def close(self) -> None:
        if self._open:
            self._open = False
            self._pins[self.seq] -= 1
            if not self._pins[self.seq]:
                del self._pins[self.seq]

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __del__(self):
        self.close()


class Store:
    def __init__(self, spark: SparkSession, folder: str, flush_bytes: int = 5 << 20, level_zero_tables: int = 4, slice_bytes: int = 4 << 20, base_bytes: int = 10 << 20):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)
        if self.files.is_file(self.folder):
            raise NotADirectoryError(self.folder)
        for sub in ("manifest", "log", "tables"):
            self.files.make_folder(f"{self.folder}/{sub}")
        self.flush_bytes, self.level_zero_tables, self.slice_bytes, self.base_bytes = flush_bytes, level_zero_tables, slice_bytes, base_bytes
        self.manifests = ManifestStore(self.files, f"{self.folder}/manifest")
        self.manifest, self.version = self.manifests.load()
        self.failed = False
        self.pins: Counter = Counter()
        self.cursors: dict[int, bytes] = {}
        self._vacuum()
        self.streams = dict(self.manifest.streams)
        for name in self.files.names(self._log()):
            if "_of_" in name:
                stream, number = name.split("_of_")[1].split("_")
                stream = bytes.fromhex(stream).decode()
                self.streams[stream] = max(int(number), self.streams.get(stream, -1))
        stats = self.tail().agg(F.max("seq"), F.sum(entry_size())).first()
        self.next_seq = max(self.manifest.last_seq, stats[0] or 0) + 1
        self.tail_bytes = stats[1] or 0

    # ---- writes

    def put(self, key: bytes, value: bytes) -> bool:
        return self.write(Batch().put(key, value))

    def remove(self, key: bytes) -> bool:
        return self.write(Batch().remove(key))

    def write(self, batch: Batch) -> bool:
        """Each operation takes the next sequence; the batch becomes durable as a whole or not at all."""
        if self.failed:
            return False
        if not batch.rows:
            return True
        rows = [(bytearray(k), self.next_seq + i, TOMBSTONE if op == "remove" else VALUE, bytearray(v)) for i, (op, k, v) in enumerate(batch.rows)]
        size = sum(len(k) + len(v) + 9 for _, k, v in batch.rows)
        return self._append(self.spark.createDataFrame(rows, RECORD).coalesce(1), len(rows), size)

    def write_frame(self, ops: DataFrame, stream: tuple[str, int] | None = None) -> bool:
        """A batch of any size: op_idx, op, key, value.

        stream: name and number of a stream's batch; one that is in the store already is not written again.
        """
        if self.failed:
            return False
        if stream and stream[1] <= self.streams.get(stream[0], -1):
            return True
        ops = ops.select(*[F.col(f.name).cast(f.dataType) for f in OPERATION.fields])
        stats = ops.agg(F.count("*"), F.sum(F.octet_length("key") + F.when(F.col("op") == "remove", 0).otherwise(F.coalesce(F.octet_length("value"), F.lit(0))) + 9)).first()
        return not stats[0] or self._append(assign_sequence(ops, self.next_seq - 1), stats[0], stats[1], stream)

    def _append(self, records: DataFrame, count: int, size: int, stream: tuple[str, int] | None = None) -> bool:
        first = self.next_seq
        self.next_seq += count  # a failed batch uses its sequences up
        place = f"{self._log()}/batch_{first}"
        if stream:  # the name says in one step that the batch is there and whose it is
            place += f"_of_{stream[0].encode().hex()}_{stream[1]}"
        try:
            records.write.parquet(f"{self._log()}/.new_{first}")
            self.files.rename(f"{self._log()}/.new_{first}", place)
        except Exception:
            self.failed = True
            return False
        self.tail_bytes += size
        if stream:
            self.streams[stream[0]] = stream[1]
        if self.tail_bytes > self.flush_bytes:
            try:
                self.flush()
            except Exception:  # the batch is in the log; later writes are refused
                pass
        return True

    # ---- reads

    def tail(self) -> DataFrame:
        """All versions since the last flush."""
        paths = [f"{self._log()}/{n}" for n in self.files.names(self._log()) if n.startswith("batch_")]
        return self._read(paths)

    def log(self, start: bytes | None = None, end: bytes | None = None, key: bytes | None = None) -> DataFrame:
        """All versions in tail and live tables; tables out of range are not opened."""
        live = self.manifest.tables
        if key is not None:
            live = self.manifest.for_key(key)
        elif start is not None:
            live = self.manifest.for_scan(start, end)
        return self.tail().unionByName(self._read([self._table(t.number) for t in live]))

    def scan(self, start: bytes, end: bytes, read_seq: int | None = None) -> DataFrame:
        """Visible records with start <= key < end, by key."""
        return reads.scan(self.log(start, end), bytearray(start), bytearray(end), read_seq)

    def get(self, key: bytes, read_seq: int | None = None) -> bytes | None:
        found = reads.get(self.log(key=key), bytearray(key), read_seq).collect()
        return bytes(found[0]["value"]) if found else None

    def multi_get(self, probes: DataFrame, read_seq: int | None = None) -> DataFrame:
        """Only tables that meet the range of the probes' keys are opened."""
        ends = probes.agg(F.min("key"), F.max("key")).first()
        live = [] if ends[0] is None else self.manifest.for_keys(bytes(ends[0]), bytes(ends[1]))
        log = self.tail().unionByName(self._read([self._table(t.number) for t in live]))
        return reads.multi_get(log, probes, read_seq)

    def snapshot(self) -> Snapshot:
        return Snapshot(self.pins, self.next_seq - 1)

    @property
    def active_snapshots(self) -> int:
        return sum(self.pins.values())

    def oldest_reader(self) -> int:
        return min(self.pins, default=self.next_seq - 1)

    # ---- flush and compaction

    def flush(self) -> None:
        """The tail becomes a table of level 0."""
        tail = self.tail()
        bounds = tail.agg(F.min("key"), F.max("key")).first()
        if bounds[0] is None:
            return
        try:
            staged, number = self.manifest.allocate()
            staged, log_number = staged.allocate()
            self._write_table(number, tail)
            table = Table(number, 0, self.files.size(self._table(number)), bytes(bounds[0]), bytes(bounds[1]))
            old = self._log()
            self._publish(replace(staged.add(table), log_number=log_number, last_seq=self.next_seq - 1, streams=tuple(sorted(self.streams.items()))))
            self.tail_bytes = 0
            self.files.delete(old)
            self.maybe_compact()
        except Exception:
            self.failed = True
            raise

    def compact(self) -> None:
        """Level 0 into level 1, once."""
        self._compact_level(0)

    def maybe_compact(self) -> None:
        while True:
            if len(self.manifest.level(0)) > self.level_zero_tables:
                self._compact_level(0)
                continue
            over = next((n for n in range(1, self.manifest.level_count()) if sum(t.size for t in self.manifest.level(n)) > self.base_bytes * 10 ** (n - 1)), None)
            if over is None:
                return
            self._compact_level(over)

    def _compact_level(self, n: int) -> None:
        tables = self.manifest.level(n)
        if not tables:
            return
        if n == 0:
            chosen, lo, hi = tables, min(t.min_key for t in tables), max(t.max_key for t in tables)
        else:
            cursor = self.cursors.get(n)
            one = next((t for t in tables if cursor is not None and t.min_key > cursor), tables[0])
            self.cursors[n] = one.max_key
            chosen, lo, hi = [one], one.min_key, one.max_key
        chosen = [*chosen, *(t for t in self.manifest.level(n + 1) if t.overlaps(lo, hi))]
        self._merge(chosen, n + 1)

    def _merge(self, tables: list[Table], level: int) -> None:
        kept = compaction.retain(self._read([self._table(t.number) for t in tables]), self.oldest_reader())
        runs = layout.slices(kept, self.slice_bytes)
        bounds = runs.groupBy("run").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("run").collect()  # a row for each output file
        staged, added, numbers = self.manifest, [], {}
        for r in bounds:
            staged, numbers[r["run"]] = staged.allocate()
        beside = f"{self.folder}/tables/.new_{staged.next_number}"
        runs.repartition(max(1, len(bounds)), "run").sortWithinPartitions("run", "key", F.desc("seq")).write.partitionBy("run").parquet(beside)
        for r in bounds:
            number = numbers[r["run"]]
            self.files.rename(f"{beside}/run={r['run']}", self._table(number))
            added.append(Table(number, level, self.files.size(self._table(number)), bytes(r["lo"]), bytes(r["hi"])))
        self.files.delete(beside)
        self._publish(staged.swap({t.number for t in tables}, added))
        for t in tables:
            self.files.delete(self._table(t.number))

    # ---- folders

    def _log(self) -> str:
        return f"{self.folder}/log/log_{self.manifest.log_number}"

    def _table(self, number: int) -> str:
        return f"{self.folder}/tables/table_{number}"

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RECORD).parquet(*paths) if paths else self.spark.createDataFrame([], RECORD)

    def _write_table(self, number: int, records: DataFrame) -> None:
        """Rows by key and newest first (a sequence is given once, so nothing ties); the key's Bloom filter and page index
        serve point reads."""
        beside = f"{self.folder}/tables/.new_{number}"
        ordered = records.repartitionByRange("key").sortWithinPartitions("key", F.desc("seq"))
        ordered.write.option("parquet.bloom.filter.enabled#key", "true").parquet(beside)
        self.files.rename(beside, self._table(number))

    def _publish(self, manifest: Manifest) -> None:
        self.version = self.manifests.save(manifest, self.version)
        self.manifest = manifest

    def _vacuum(self) -> None:
        """Deletes what no manifest names: unfinished files, tables of failed writers, logs that are flushed."""
        live = {f"table_{n}" for n in self.manifest.numbers()}
        for name in self.files.names(f"{self.folder}/tables"):
            if name.startswith(".new_") or (name.startswith("table_") and name[6:].isdigit() and name not in live):
                self.files.delete(f"{self.folder}/tables/{name}")
        for name in self.files.names(f"{self.folder}/log"):
            if name.startswith("log_") and name[4:].isdigit() and int(name[4:]) < self.manifest.log_number:
                self.files.delete(f"{self.folder}/log/{name}")
        for name in self.files.names(self._log()):
            if name.startswith(".new_"):
                self.files.delete(f"{self._log()}/{name}")


