"""Schemas of the data model: change-log records, operations, table metadata."""

from __future__ import annotations

from pyspark.sql import types as T

#: Record kinds, as stored.
VALUE, TOMBSTONE = 0, 1

RECORD = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("type", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
OPERATION = T.StructType(
    [
        T.StructField("op_idx", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
TABLE_META = T.StructType(
    [
        T.StructField("number", T.LongType(), False),
        T.StructField("level", T.IntegerType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("min_key", T.BinaryType(), False),
        T.StructField("max_key", T.BinaryType(), False),
    ]
)
