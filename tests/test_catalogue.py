"""Every registered query of the engine against its SQL twin."""

import os

import duckdb
import pytest

from kelpie import catalogue

FOLDER = os.environ.get("KELPIE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([bytes(r[i]) if isinstance(r[i], bytearray) else r[i] for i in order]) for r in found)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    got = df.collect()
    found = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, got) == rows(found.columns, found.fetchall())


def test_checksums_are_those_of_the_images(spark):
    import zlib

    import pyspark.sql.functions as F

    from kelpie.functions import scalars

    log = catalogue.log(spark, FOLDER)
    args = [F.col(c) for c in ("key", "seq", "type", "value")]
    for r in log.select(scalars.encode_record(*args).alias("image"), scalars.record_checksum(*args).alias("sum")).collect():
        assert zlib.crc32(bytes(r["image"])) == r["sum"]
