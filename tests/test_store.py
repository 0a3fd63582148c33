"""The store end to end: batches, snapshots, flush, compaction, recovery, failures, streams."""

import pytest
from pyspark.sql import functions as F

from kelpie.plans.manifest import Manifest, Table
from kelpie.sources.files import Files
from kelpie.store import Batch, Store
from kelpie.streaming import ingest


def rows(df):
    return [(bytes(r["key"]).decode(), bytes(r["value"]).decode()) for r in df.collect()]


def everything(store, read_seq=None):
    return dict(rows(store.scan(b"", b"~", read_seq)))


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/store"


def test_each_operation_of_a_batch_has_a_sequence(spark, folder):
    s = Store(spark, folder)
    assert s.snapshot().seq == 0
    b = Batch().put(b"key", b"first").remove(b"key").put(b"key", b"last")
    assert s.write(b) and s.write(Batch())
    assert [s.get(b"key", n) for n in (1, 2, 3)] == [b"first", None, b"last"]
    s.write(b)
    assert s.next_seq == 7


def test_snapshot_scan(spark, folder):
    s = Store(spark, folder)
    s.write(Batch().put(b"alpha", b"old").put(b"deleted", b"visible"))
    with s.snapshot() as snap:
        s.write(Batch().put(b"alpha", b"new").remove(b"deleted").put(b"fresh", b"new-value"))
        assert everything(s, snap.seq) == {"alpha": "old", "deleted": "visible"}
        assert everything(s) == {"alpha": "new", "fresh": "new-value"}
        assert s.active_snapshots == 1
    snap.close()
    assert s.active_snapshots == 0


def test_flush_compact_and_reopen(spark, folder):
    s = Store(spark, folder)
    s.put(b"a", b"1")
    s.flush()
    s.flush()  # an empty tail is left alone
    assert len(s.manifest.level(0)) == 1
    s.put(b"a", b"2")
    s.remove(b"b")
    s.flush()
    s.compact()
    assert not s.manifest.level(0) and [(t.min_key, t.max_key) for t in s.manifest.level(1)] == [(b"a", b"b")]
    s.put(b"c", b"tail")
    again = Store(spark, folder)
    assert everything(again) == {"a": "2", "c": "tail"} and again.next_seq == s.next_seq == 5
    assert again.get(b"b") is None and again.get(b"c") == b"tail"


def test_compaction_keeps_what_a_snapshot_sees(spark, folder):
    s = Store(spark, folder)
    s.put(b"k", b"1")
    snap = s.snapshot()
    s.put(b"k", b"2")
    s.put(b"k", b"3")
    s.flush()
    s.compact()
    assert s.get(b"k", snap.seq) == b"1" and s.log().count() == 3
    snap.close()
    s.put(b"z", b"")
    s.flush()
    s.compact()
    assert s.log().count() == 3 or everything(s) == {"k": "3", "z": ""}
    s.put(b"k", b"4")
    s.flush()
    s.compact()
    assert sorted(r["seq"] for r in s.log().where(F.col("key") == F.lit(b"k")).collect()) == [5]


def test_thresholds_trigger_flush_and_cascade(spark, folder):
    s = Store(spark, folder, flush_bytes=9 + 2, level_zero_tables=1, slice_bytes=1, base_bytes=1)
    s.put(b"a", b"1")
    assert not s.manifest.tables  # equal is not above
    s.put(b"b", b"1")
    assert len(s.manifest.level(0)) == 1
    s.put(b"c", b"1")
    s.put(b"d", b"1")
    assert not s.manifest.level(0) and s.manifest.level_count() > 2
    assert everything(s) == {k: "1" for k in "abcd"}
    for n in range(1, s.manifest.level_count()):
        level = s.manifest.level(n)
        assert all(x.max_key < y.min_key for x, y in zip(level, level[1:], strict=False))


def test_frame_batches(spark, folder):
    s = Store(spark, folder)
    ops = spark.range(1000).select(F.col("id").alias("op_idx"), F.when(F.col("id") % 10 == 0, "remove").otherwise("put").alias("op"), (F.col("id") % 50).cast("string").alias("key"), F.col("id").cast("string").alias("value"))
    assert s.write_frame(ops) and s.next_seq == 1001
    got = everything(s)
    assert len(got) == 45 and got["7"] == "957" and "0" not in got
    probes = spark.createDataFrame([(bytearray(b"7"),), (bytearray(b"0"),), (bytearray(b"x"),)], "key binary")
    assert {bytes(r["key"]): r["state"] for r in s.multi_get(probes).collect()} == {b"7": "VALUE", b"0": "TOMBSTONE", b"x": "ABSENT"}


def test_failed_publication_leaves_the_former_state(spark, folder):
    s = Store(spark, folder)
    s.write(Batch().put(b"a", b"1").remove(b"gone"))

    def fail(step, path):
        if step == "rename" and "manifest_" in path:
            raise OSError("no")

    s.files.before = fail
    with pytest.raises(OSError):
        s.flush()
    assert s.failed and not s.put(b"b", b"2")
    again = Store(spark, folder)
    assert everything(again) == {"a": "1"} and not again.manifest.tables
    assert not [n for n in Files(spark).names(f"{folder}/tables")]
    again.flush()
    assert everything(again) == {"a": "1"}


def test_failed_append_is_not_seen(spark, folder):
    s = Store(spark, folder)
    s.put(b"a", b"1")

    def fail(step, path):
        raise OSError("no")

    s.files.before = fail
    assert not s.put(b"a", b"2")
    assert everything(Store(spark, folder)) == {"a": "1"}


def test_strange_folders(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    with pytest.raises(NotADirectoryError):
        Store(spark, f"file://{tmp_path}/file")


def test_strange_keys(spark, folder):
    keys = [b"", b"a,b=c", b"line\nkey", b"e\0f", b"\xff"]
    s = Store(spark, folder)
    b = Batch()
    for k in keys:
        b.put(k, k + b"!")
    s.write(b)
    s.flush()
    assert all(s.get(k) == k + b"!" for k in keys)


def test_manifest_rules():
    t = lambda n, level, lo, hi, size=1: Table(n, level, size, lo, hi)
    m = Manifest(tables=(t(1, 0, b"a", b"z"), t(3, 0, b"b", b"c"), t(10, 1, b"b", b"d"), t(11, 1, b"g", b"k")))
    assert [x.number for x in m.level(0)] == [3, 1] and m.level(7) == [] and m.numbers() == [11, 10, 3, 1]
    find = lambda k: getattr(m.table_for(1, k), "number", None)
    assert [find(k) for k in (b"a", b"b", b"d", b"e", b"g", b"k")] == [None, 10, 10, None, 11, 11]
    with pytest.raises(ValueError):
        m.table_for(0, b"a")
    with pytest.raises(ValueError):
        m.add(t(12, 1, b"d", b"f"))
    assert Manifest.from_json(m.to_json()) == m
    scans = Manifest(tables=(t(1, 1, b"alpha", b"bravo"), t(2, 1, b"delta", b"foxtrot"), t(3, 1, b"hotel", b"juliet")))
    assert [x.number for x in scans.for_scan(b"charlie", b"india")] == [2, 3]
    assert [x.number for x in scans.for_scan(b"bravo", b"delta")] == [1]


def test_stream_into_store(spark, folder, tmp_path):
    source = str(tmp_path / "in")
    spark.range(100).select(F.col("id").alias("op_idx"), F.lit("put").alias("op"), (F.col("id") % 10).cast("string").cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value")).coalesce(1).write.parquet(source)
    s = Store(spark, folder)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    ingest.stream_into(s, stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert everything(s) == {str(i): str(90 + i) for i in range(10)}


def test_a_stream_batch_is_applied_once(spark, folder):
    s = Store(spark, folder)
    ops = spark.createDataFrame([(0, "put", bytearray(b"a"), bytearray(b"1"))], "op_idx long, op string, key binary, value binary")
    assert s.write_frame(ops, ("in", 0)) and s.write_frame(ops, ("in", 0)) and s.write_frame(ops, ("other", 0))
    assert s.next_seq == 3
    again = Store(spark, folder)
    assert again.streams == {"in": 0, "other": 0} and again.write_frame(ops, ("in", 0)) and again.next_seq == 3
    again.flush()
    after = Store(spark, folder)
    assert after.write_frame(ops, ("in", 0)) and after.next_seq == 3 and after.write_frame(ops, ("in", 1)) and after.next_seq == 4


def test_views_keep_changes_and_merge_them(spark, tmp_path):
    rows = [(f"k{i % 7}", i, i % 5 == 0, str(i)) for i in range(60)]
    source = str(tmp_path / "in")
    for i in range(6):
        spark.createDataFrame([(k, s, int(t), v) for k, s, t, v in rows[i * 10 : i * 10 + 10]], "key string, seq long, type int, value string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("key string, seq long, type int, value string").option("maxFilesPerTrigger", 1).parquet(source)
    target = str(tmp_path / "view")
    ingest.latest_view(stream, target, str(tmp_path / "checkpoint"), every=4).awaitTermination()
    newest = {k: (s, t, v) for k, s, t, v in rows}
    got = {r["key"]: (r["seq"], bool(r["type"]), r["value"]) for r in ingest.read_view(spark, target, 6).collect()}
    assert got == {k: x for k, x in newest.items() if not x[1]}
    import os

    assert sorted(x for x in os.listdir(target) if not x.startswith(".")) == ["change_4", "change_5", "whole_3"]
