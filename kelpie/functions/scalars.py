"""Scalar expressions over record columns; all run in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed parts of the encodings, in bytes.
RECORD_HEADER, RECORD_CHECKSUM, ENTRY_EXTRA = 17, 4, 9
_LOW = 0xFFFFFFFF


def octets(x: Column | str) -> Column:
    return F.octet_length(x).cast("long")


def encoded_size(key: Column | str = "key", value: Column | str = "value") -> Column:
    """Bytes of a record in a sorted table file."""
    return octets(key) + F.coalesce(octets(value), F.lit(0)) + RECORD_HEADER + RECORD_CHECKSUM


def entry_size(key: Column | str = "key", value: Column | str = "value") -> Column:
    """Bytes that a record counts for in the unflushed tail."""
    return octets(key) + F.coalesce(octets(value), F.lit(0)) + ENTRY_EXTRA


def little_endian(x: Column, width: int) -> Column:
    """A non-negative integer as `width` bytes, least significant first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(x.cast("long"), 8 * i).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for i in range(width)]))


def encode_record(key: Column, seq: Column, kind: Column, value: Column) -> Column:
    """The table-file encoding without its checksum: type, seq, key and value lengths, key, value."""
    k, v = key.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b""))
    return F.concat(little_endian(kind, 1), little_endian(seq, 8), little_endian(octets(k), 4), little_endian(octets(v), 4), k, v)


def record_checksum(key: Column, seq: Column, kind: Column, value: Column) -> Column:
    return F.crc32(encode_record(key, seq, kind, value))


def log_record(key: Column, seq: Column, kind: Column, value: Column) -> Column:
    """The write-ahead log's text form of one operation."""
    v = F.coalesce(value, F.lit(""))
    return F.concat(F.when(kind == 0, "P,").otherwise("D,"), seq.cast("string"), F.lit(","), octets(key).cast("string"), F.lit(","), key, F.lit("="), octets(v).cast("string"), F.lit(","), v, F.lit("\n"))


def fnv1a(x: Column) -> Column:
    """64-bit FNV-1a as struct<hi, lo> of two unsigned 32-bit halves.

    The prime is 2**40 + 435, so one step is hi' = hi * 435 + carry + (lo ^ b) * 2**8 and lo' = (lo ^ b) * 435, both
    modulo 2**32, and nothing overflows a signed long.
    """
    low = F.lit(_LOW).cast("long")
    data = F.hex(x.cast("binary"))
    # sequence(1, 0) counts down, so an empty input needs an array of its own
    at = F.when(F.length(data) > 0, F.sequence(F.lit(1), (F.length(data) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, i: Column) -> Column:
        byte = F.conv(F.substr(data, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
        mixed = acc["lo"].bitwiseXOR(byte)
        product = mixed * 435
        hi = acc["hi"] * 435 + F.shiftrightunsigned(product, 32) + F.shiftleft(mixed, 8)
        return F.struct(hi.bitwiseAND(low).alias("hi"), product.bitwiseAND(low).alias("lo"))

    seed = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    return F.aggregate(at, seed, step)


def fnv1a_hex(x: Column) -> Column:
    h = fnv1a(x)
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))


def bloom_parameters(entries: int, false_positives: float = 0.01) -> tuple[int, int]:
    """Bits and hash count for so many entries. An empty filter gets one bit, so that positions stay defined."""
    if entries <= 0:
        return 1, 1
    bits = -entries * math.log(false_positives) / math.log(2) ** 2
    return math.ceil(bits), math.floor(bits / entries * math.log(2) + 0.5)


def bit_positions(x: Column, bits: int, hashes: int) -> Column:
    """array<long> of a key's positions: (hi + i * lo) mod bits, with lo = 0 counted as 1."""
    one = F.transform(F.array(fnv1a(x)), lambda h: F.struct(h["hi"].alias("hi"), F.when(h["lo"] == 0, F.lit(1).cast("long")).otherwise(h["lo"]).alias("lo")))
    spread = F.transform(one, lambda h: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(hashes - 1).cast("long")), lambda i: (h["hi"] + i * h["lo"]) % bits))
    return F.flatten(spread)


def file_number(name: Column, prefix: str, suffix: str) -> Column:
    """The number in prefix<number>suffix, else null."""
    digits = F.regexp_extract(name, f"^{prefix}([0-9]+){suffix.replace('.', '[.]')}$", 1)
    return F.when(digits != "", digits.try_cast("long"))


def log_path(directory: Column, number: Column) -> Column:
    return F.concat(directory, F.lit("/wal/wal_"), number.cast("string"), F.lit(".wal"))


def table_path(directory: Column, number: Column) -> Column:
    return F.concat(directory, F.lit("/sstable/sst_"), number.cast("string"), F.lit(".sst"))
