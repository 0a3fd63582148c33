"""Byte formats: goldens, round trips, damage."""

import zlib

import pytest
from pyspark.sql import functions as F

from kelpie.plans.manifest import Manifest, Table
from kelpie.sources import formats
from kelpie.sources.formats import Corrupt

RECORDS = [(b"key", 1, 0, b"first"), (b"key", 2, 1, b""), (b"key", 3, 0, b"last")]
ODD = [(b"", 9, 0, b""), (b"a,b=c", 8, 0, b"v=1,ok"), (b"e\0f", 7, 1, b""), (b"line\nkey", 6, 0, b"line\nvalue\r\n")]
FRAME = formats.encode_batch(RECORDS)


def test_log_golden():
    assert FRAME[:4] == b"WFRM" and FRAME[-4:] == b"WCMT"
    assert FRAME[12:-8] == b"3,P,1,3,key=5,first\nD,2,3,key=0,\nP,3,3,key=4,last\n"


def test_log_round_trip():
    data = formats.LOG_HEADER + FRAME + formats.encode_batch(ODD)
    assert formats.parse_log(data) == (RECORDS + ODD, len(data))
    assert formats.parse_log(formats.LOG_HEADER) == ([], 5)


@pytest.mark.parametrize("tail", [b"\0" * 30, b"garbage", FRAME[:-1], FRAME[:10]])
def test_torn_tail_is_dropped(tail):
    data = formats.LOG_HEADER + FRAME
    assert formats.parse_log(data + tail) == (RECORDS, len(data))


@pytest.mark.parametrize(
    "data",
    [b"LW", b"XWAL\x02" + FRAME, b"LWAL\x01" + FRAME, formats.LOG_HEADER + b"x" + FRAME, formats.LOG_HEADER + FRAME[:20] + b"#" + FRAME[21:], formats.LOG_HEADER + FRAME[:4] + b"\xff" * 8 + FRAME[12:], formats.LOG_HEADER + FRAME[:-4] + b"WCMX" + FRAME],
)
def test_damage_is_an_error(data):
    with pytest.raises(Corrupt):
        formats.parse_log(data)


def frame_of(payload):
    """A frame made from the format's description alone."""
    return b"WFRM" + len(payload).to_bytes(8, "little") + payload + zlib.crc32(payload).to_bytes(4, "little") + b"WCMT"


def test_a_log_from_its_description():
    data = b"LWAL\x02" + frame_of(b"3,P,1,3,key=5,first\nD,2,3,key=0,\nP,3,3,key=4,last\n") + frame_of(b"0,")
    assert formats.parse_log(data) == (RECORDS, len(data))


@pytest.mark.parametrize("payload", [b"", b"P,1,1,a=1,b\n", b"2,P,1,1,a=1,b\n", b"1,P,1,1,a=1,b\nP,2,1,a=1,b\n", b"1,P,1,99,a=1,b\n", b"1,P,1,1,a=99,b\n", b"1,P,1,1,a=99999999999999999999,b\n", b"99999999999999999999,P,1,1,a=1,b\n", b"1,X,1,1,a=1,b\n", b"-1,"])
def test_counts_that_do_not_fit(payload):
    with pytest.raises(Corrupt):
        formats.parse_log(formats.LOG_HEADER + frame_of(payload))


def test_appends_after_a_torn_tail():
    for tail in (b"\0" * 30, b"garbage", FRAME[:-1], FRAME[:10]):
        records, kept = formats.reopen_log(formats.LOG_HEADER + FRAME + tail)
        assert records == RECORDS and formats.parse_log(kept + formats.encode_batch(ODD))[0] == RECORDS + ODD


def test_a_folder_of_logs_and_tables(spark, tmp_path):
    for sub in ("wal", "sstable"):
        (tmp_path / sub).mkdir()
    assert formats.read_store(spark, str(tmp_path)).count() == 0
    (tmp_path / "wal" / "wal_1.wal").write_bytes(b"LWAL\x02broken and not read")
    (tmp_path / "wal" / "wal_3.wal").write_bytes(formats.LOG_HEADER + FRAME + b"torn")
    (tmp_path / "sstable" / "sst_2.sst").write_bytes(formats.encode_table(ODD))
    (tmp_path / "sstable" / "sst_9.sst").write_bytes(b"of no manifest")
    (tmp_path / "MANIFEST").write_bytes(formats.encode_manifest(Manifest(3, 10, 9, (Table(2, 0, 1, b"", b"line\nkey"),))))
    got = formats.read_store(spark, str(tmp_path)).collect()
    assert sorted((bytes(r["key"]), r["seq"], r["type"], bytes(r["value"])) for r in got) == sorted(RECORDS + ODD)


def test_record_goldens():
    assert formats.encode_record((b"a", 0x0102030405060708, 0, b"xy")).hex() == "000807060504030201010000000200000061787976" + "0ae8e6"
    assert formats.encode_record((b"long", 0x1112131415161718, 0, b"")).hex() == "00181716151413121104000000000000006c6f6e678bd0d436"


def test_table_round_trip_and_lookup():
    rows = [(f"key-{i:02d}".encode(), 100 - v, v % 2, b"v" * 400) for i in range(12) for v in range(4)]
    data = formats.encode_table(rows)
    body, bloom, index = formats.table_parts(data)
    assert list(formats.parse_records(body)) == rows
    assert [k for k, _ in formats.parse_index(index, len(body))][0] == b"key-00"
    assert formats.parse_bloom(bloom)[:2] == (461, 7)
    for key, seq, _, _ in rows:
        assert formats.find_in_table(data, key, seq)[1] == seq
        assert formats.find_in_table(data, key)[1] == 100
    assert formats.find_in_table(data, b"key-03", 90) is None
    assert formats.find_in_table(data, b"nothing") is None and formats.find_in_table(data, b"") is None


def test_every_damaged_byte_of_a_table_is_noticed():
    rows = [(b"alpha", 2, 0, b"one"), (b"beta", 1, 1, b"")]
    data = formats.encode_table(rows)
    body = len(formats.table_parts(data)[0])
    for i in [*range(body), *range(len(data) - 24, len(data))]:
        broken = data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :]
        with pytest.raises(Corrupt):
            assert list(formats.parse_records(formats.table_parts(broken)[0])) == rows
            raise AssertionError(i)


def test_manifest_round_trip():
    m = Manifest(3, 9, 77, (Table(5, 0, 10, b"", b"z\0\n"), Table(4, 0, 11, b"a", b"b"), Table(2, 2, 12, b"c", b"d")))
    back = formats.parse_manifest(formats.encode_manifest(m))
    assert back.log_number == 3 and back.next_number == 9 and back.last_seq == 77 and set(back.tables) == set(m.tables)
    with pytest.raises(Corrupt):
        formats.parse_manifest(formats.encode_manifest(m)[:-1])
    data = bytearray(formats.encode_manifest(m))
    data[16] = 3
    with pytest.raises(Corrupt):
        formats.parse_manifest(bytes(data))


def test_files_as_frames(spark, tmp_path):
    (tmp_path / "wal_1.wal").write_bytes(formats.LOG_HEADER + FRAME)
    (tmp_path / "wal_2.wal").write_bytes(formats.LOG_HEADER + formats.encode_batch(ODD) + b"torn")
    got = formats.read_logs(spark, str(tmp_path / "*.wal")).collect()
    assert sorted((bytes(r["key"]), r["seq"], r["type"], bytes(r["value"])) for r in got) == sorted(RECORDS + ODD)
    (tmp_path / "sst_3.sst").write_bytes(formats.encode_table(ODD))
    assert formats.read_tables(spark, str(tmp_path / "sst_3.sst")).count() == len(ODD)


def test_table_images(spark):
    df = spark.createDataFrame([(bytearray(k), s, t, bytearray(v)) for k, s, t, v in reversed(ODD)], "key binary, seq long, type byte, value binary").withColumn("run", F.lit(4))
    row = formats.table_images(df, "run").first()
    assert row["run"] == 4 and bytes(row["content"]) == formats.encode_table(ODD)
