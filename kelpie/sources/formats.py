"""Byte formats of write-ahead logs, sorted tables and manifests, for exchange with other engines.

Files are read with Spark's binaryFile source, one task for each, since a log can only be told torn or corrupt as a whole.
All integers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import bloom_parameters
from ..plans.manifest import FORMAT, Manifest, Table
from ..schema import RECORD, TOMBSTONE

# Fixed values of the formats.
LOG_HEADER = b"LWAL\x02"
FRAME_START, FRAME_END = b"WFRM", b"WCMT"
FRAME_EXTRA = 20
BLOCK_BYTES = 4096
FALSE_POSITIVES = 0.01
FNV_SEED, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3

Record = tuple[bytes, int, int, bytes]


class Corrupt(ValueError):
    """The bytes are not what a writer of the format leaves."""


# ---- write-ahead log


def encode_batch(records: Iterable[Record]) -> bytes:
    """One committed frame: the number of records, then each of them."""
    records = list(records)
    payload = b"%d," % len(records) + b"".join(b"%s,%d,%d,%s=%d,%s\n" % (b"D" if kind == TOMBSTONE else b"P", seq, len(key), key, len(value), value) for key, seq, kind, value in records)
    return FRAME_START + struct.pack("<Q", len(payload)) + payload + struct.pack("<I", zlib.crc32(payload)) + FRAME_END


def _frame(data: bytes, at: int) -> tuple[bytes, int, int] | None:
    """Payload, stored checksum and end of a complete frame."""
    if data[at : at + 4] != FRAME_START or len(data) - at < FRAME_EXTRA:
        return None
    (size,) = struct.unpack_from("<Q", data, at + 4)
    if size > len(data) - at - FRAME_EXTRA:
        return None
    body = at + 12
    if data[body + size + 4 : body + size + 8] != FRAME_END:
        return None
    return data[body : body + size], struct.unpack_from("<I", data, body + size)[0], body + size + 8


def _number(payload: bytes, at: int, stop: bytes) -> tuple[int, int]:
    end = payload.find(stop, at)
    text = payload[at:end] if end >= 0 else b""
    if not text.isdigit():
        raise Corrupt("number in a log record")
    return int(text), end + 1


def parse_batch(payload: bytes) -> list[Record]:
    count, at = _number(payload, 0, b",")
    out: list[Record] = []
    while len(out) < count:
        op = payload[at : at + 2]
        if op not in (b"P,", b"D,"):
            raise Corrupt("operation in a log record")
        seq, at = _number(payload, at + 2, b",")
        size, at = _number(payload, at, b",")
        key, at = payload[at : at + size], at + size
        if len(key) < size or payload[at : at + 1] != b"=":
            raise Corrupt("key in a log record")
        size, at = _number(payload, at + 1, b",")
        value, at = payload[at : at + size], at + size
        if len(value) < size or payload[at : at + 1] != b"\n":
            raise Corrupt("value in a log record")
        at += 1
        out.append((key, seq, int(op == b"D,"), value))
    if at != len(payload):
        raise Corrupt("bytes after the records of a batch")
    return out


def parse_log(data: bytes) -> tuple[list[Record], int]:
    """All committed records, and where the committed part ends. An unfinished last append is left out; damage before a
    committed frame, or in one, is an error."""
    if data[:5] != LOG_HEADER:
        raise Corrupt("log header")
    out, at = [], 5
    while at < len(data):
        found = _frame(data, at)
        if found is None:
            committed_end = len(data) - at >= FRAME_EXTRA and data.endswith(FRAME_END)
            if committed_end or _later_frame(data, at + 1):
                raise Corrupt("damage before a committed batch")
            break
        payload, checksum, end = found
        if zlib.crc32(payload) != checksum:
            raise Corrupt("checksum of a batch")
        out += parse_batch(payload)
        at = end
    return out, at


def reopen_log(data: bytes) -> tuple[list[Record], bytes]:
    """The committed records, and the log without an unfinished last append, to which batches can be appended."""
    records, end = parse_log(data)
    return records, data[:end]


def _later_frame(data: bytes, at: int) -> bool:
    while (at := data.find(FRAME_START, at)) >= 0:
        found = _frame(data, at)
        if found and zlib.crc32(found[0]) == found[1]:
            return True
        at += 1
    return False


# ---- sorted table


def encode_record(record: Record) -> bytes:
    key, seq, kind, value = record
    body = struct.pack("<BQII", kind, seq, len(key), len(value)) + key + value
    return body + struct.pack("<I", zlib.crc32(body))


def fnv1a(key: bytes) -> int:
    h = FNV_SEED
    for b in key:
        h = (h ^ b) * FNV_PRIME % 2**64
    return h


def positions(key: bytes, bits: int, hashes: int) -> list[int]:
    h = fnv1a(key)
    first, second = h >> 32, h % 2**32 or 1
    return [(first + i * second) % bits for i in range(hashes)]


def encode_table(records: list[Record]) -> bytes:
    """A table of records that are sorted by key and newest first."""
    if not records:
        raise ValueError("a table has a record at least")
    bits, hashes = bloom_parameters(len(records), FALSE_POSITIVES)
    filled = bytearray(-(-bits // 64) * 8)
    body, index, block = bytearray(), [], 0
    for r in records:
        if not body or block > BLOCK_BYTES:
            index.append(struct.pack("<I", len(r[0])) + r[0] + struct.pack("<Q", len(body)))
            block = 0
        encoded = encode_record(r)
        body += encoded
        block += len(encoded)
        for p in positions(r[0], bits, hashes):
            filled[p // 8] |= 1 << p % 8  # little-endian words are little-endian bytes
    bloom = struct.pack("<QQ", bits, hashes) + bytes(filled)
    entries = b"".join(index)
    return bytes(body) + bloom + entries + struct.pack("<QQQ", len(body), len(bloom), len(entries))


def table_parts(data: bytes) -> tuple[bytes, bytes, bytes]:
    """Records, Bloom filter and index, if the footer's sizes add up."""
    if len(data) < 24:
        raise Corrupt("table size")
    r, b, i = struct.unpack("<QQQ", data[-24:])
    if not r or r + b + i + 24 != len(data):
        raise Corrupt("table footer")
    return data[:r], data[r : r + b], data[r + b : r + b + i]


def parse_records(body: bytes) -> Iterator[Record]:
    at = 0
    while at < len(body):
        if len(body) - at < 21:
            raise Corrupt("record header")
        kind, seq, k, v = struct.unpack_from("<BQII", body, at)
        end = at + 17 + k + v
        if kind > 1 or end + 4 > len(body):
            raise Corrupt("record length or type")
        if zlib.crc32(body[at:end]) != struct.unpack_from("<I", body, end)[0]:
            raise Corrupt("record checksum")
        yield body[at + 17 : at + 17 + k], seq, kind, body[at + 17 + k : end]
        at = end + 4


def parse_index(data: bytes, records_size: int) -> list[tuple[bytes, int]]:
    out, at = [], 0
    while at < len(data):
        if len(data) - at < 12:
            raise Corrupt("index header")
        (k,) = struct.unpack_from("<I", data, at)
        if k > len(data) - at - 12:
            raise Corrupt("index length")
        out.append((data[at + 4 : at + 4 + k], struct.unpack_from("<Q", data, at + 4 + k)[0]))
        at += 12 + k
    offsets = [o for _, o in out]
    ordered = all(a < b for a, b in zip(offsets, offsets[1:], strict=False)) and all(a[0] <= b[0] for a, b in zip(out, out[1:], strict=False))
    if not out or offsets[0] or offsets[-1] >= records_size or not ordered:
        raise Corrupt("index order")
    return out


def parse_bloom(data: bytes) -> tuple[int, int, bytes]:
    if len(data) < 16 or len(data) % 8:
        raise Corrupt("Bloom filter size")
    bits, hashes = struct.unpack_from("<QQ", data)
    if len(data) != 16 + -(-bits // 64) * 8:
        raise Corrupt("Bloom filter size")
    return bits, hashes, data[16:]


def find_in_table(data: bytes, key: bytes, read_seq: int | None = None) -> Record | None:
    """The newest version of a key up to read_seq: filter, then index, then the key's blocks."""
    body, bloom, index = table_parts(data)
    bits, hashes, filled = parse_bloom(bloom)
    if not all(filled[p // 8] >> p % 8 & 1 for p in positions(key, bits, hashes)):
        return None
    entries = parse_index(index, len(body))
    if key < entries[0][0]:
        return None
    first = max(0, next((i for i, e in enumerate(entries) if e[0] >= key), len(entries)) - 1)
    stop = next((o for k, o in entries if k > key), len(body))
    for r in parse_records(body[entries[first][1] : stop]):
        if r[0] == key and (read_seq is None or r[1] <= read_seq):
            return r
        if r[0] > key:
            break
    return None


# ---- manifest


def encode_manifest(m: Manifest) -> bytes:
    out = struct.pack("<QQBQQ", m.level_count(), m.log_number, FORMAT, m.next_number, m.last_seq)
    for n in range(m.level_count()):
        tables = m.level(n)
        out += struct.pack("<Q", len(tables))
        for t in tables:
            out += struct.pack("<QQI", t.number, t.size, len(t.min_key)) + t.min_key + struct.pack("<I", len(t.max_key)) + t.max_key
    return out


def parse_manifest(data: bytes) -> Manifest:
    try:
        levels, log_number, version, next_number, last_seq = struct.unpack_from("<QQBQQ", data)
        if version != FORMAT:
            raise Corrupt("manifest version")
        at, tables = 33, []
        for level in range(levels):
            (count,) = struct.unpack_from("<Q", data, at)
            at += 8
            for _ in range(count):
                number, size, k = struct.unpack_from("<QQI", data, at)
                lo, at = data[at + 20 : at + 20 + k], at + 20 + k
                (k2,) = struct.unpack_from("<I", data, at)
                hi, at = data[at + 4 : at + 4 + k2], at + 4 + k2
                if len(lo) < k or len(hi) < k2:
                    raise Corrupt("manifest key")
                tables.append(Table(number, level, size, lo, hi))
    except struct.error as e:
        raise Corrupt("manifest length") from e
    return Manifest(log_number, next_number, last_seq, tuple(tables))


# ---- as DataFrames


def _rows(spark: SparkSession, path: str | list[str], parse) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content").to_pylist():
                rows = list(parse(data))
                for i in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[i : i + 10_000], strict=True))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int8(), pa.binary()), strict=True)], ["key", "seq", "type", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def read_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Committed records of all logs at path (a file, a folder or a pattern)."""
    return _rows(spark, path, lambda data: parse_log(data)[0])


def read_tables(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All versions of all tables at path, checksums verified."""
    return _rows(spark, path, lambda data: parse_records(table_parts(data)[0]))


def log_images(records: DataFrame, run: str, batch: int) -> DataFrame:
    """run and content: the log of each group of records, in batches of so many by sequence."""
    import pandas as pd

    def image(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        rows = [(bytes(k), int(s), int(t), bytes(v or b"")) for k, s, t, v in zip(pdf["key"], pdf["seq"], pdf["type"], pdf["value"], strict=True)]
        content = LOG_HEADER + b"".join(encode_batch(rows[i : i + batch]) for i in range(0, len(rows), batch))
        return pd.DataFrame({"run": [int(pdf[run].iloc[0])], "content": [content]})

    return records.groupBy(run).applyInPandas(image, "run long, content binary")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """All versions of a folder in the exchange formats: the tables that its manifest names and its logs from the manifest's
    on (folder/MANIFEST, folder/sstable/sst_<n>.sst, folder/wal/wal_<n>.wal)."""
    from .files import Files

    files = Files(spark)
    manifest = parse_manifest(files.read_bytes(f"{folder}/MANIFEST")) if files.exists(f"{folder}/MANIFEST") else Manifest()
    tables = [f"{folder}/sstable/sst_{n}.sst" for n in manifest.numbers()]
    logs = [n for n in files.names(f"{folder}/wal") if n.startswith("wal_") and n.endswith(".wal") and n[4:-4].isdigit() and int(n[4:-4]) >= manifest.log_number]
    out = spark.createDataFrame([], RECORD)
    if tables:
        out = out.unionByName(read_tables(spark, tables))
    return out.unionByName(read_logs(spark, [f"{folder}/wal/{n}" for n in logs])) if logs else out


def find_in_tables(images: DataFrame, probes: DataFrame) -> DataFrame:
    """run, key, seq, type: the newest version of each probe (run, key) in the table image (run, content) of its run."""
    import pandas as pd

    def look(images: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        content = bytes(images["content"].iloc[0]) if len(images) else None
        found = [(r, bytes(k), hit[1], hit[2]) for r, k in zip(probes["run"], probes["key"], strict=True) if content and (hit := find_in_table(content, bytes(k)))]
        return pd.DataFrame(found, columns=["run", "key", "seq", "type"])

    return images.groupBy("run").cogroup(probes.groupBy("run")).applyInPandas(look, "run long, key binary, seq long, type byte")


def table_images(records: DataFrame, run: str) -> DataFrame:
    """run and content: the file image of each group of records that makes a table."""
    import pandas as pd

    def image(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["key"], pdf["seq"], pdf["type"], pdf["value"], strict=True), key=lambda r: (bytes(r[0]), -r[1]))
        content = encode_table([(bytes(k), int(s), int(t), bytes(v or b"")) for k, s, t, v in rows])
        return pd.DataFrame({"run": [int(pdf[run].iloc[0])], "content": [content]})

    return records.groupBy(run).applyInPandas(image, "run long, content binary")
