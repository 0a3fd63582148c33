"""Folds with reset, slices, index blocks, level choices, filters and scalars."""

import random

import pytest
from pyspark.sql import functions as F

from kelpie.functions import scalars
from kelpie.operators import bloom, compaction, layout
from kelpie.plans import manifest as plans
from kelpie.sources import formats


def plain_fold(sizes, threshold):
    out, run, total = [], 0, 0
    for s in sizes:
        out.append(run)
        total += s
        if total > threshold:
            run, total = run + 1, 0
    return out


@pytest.mark.parametrize("block", [1, 3, 10, 1000])
@pytest.mark.parametrize("threshold", [0, 5, 37, 500])
def test_fold_does_not_depend_on_blocks(spark, block, threshold):
    random.seed(block * 1000 + threshold)
    sizes = [random.randint(1, 30) for _ in range(100)]
    df = spark.createDataFrame([(i, s, i // block) for i, s in enumerate(sizes)], "i long, size long, block long")
    got = [r["run"] for r in layout.fold(df, "block", ["i"], "size", threshold).orderBy("i").collect()]
    assert got == plain_fold(sizes, threshold)


@pytest.mark.parametrize("threshold", [0, 40, 200])
def test_maps_are_composed_in_a_tree(spark, monkeypatch, threshold):
    monkeypatch.setattr(layout, "FAN", 3)
    random.seed(threshold)
    sizes = [random.choice([1, 7, 30, 90]) for _ in range(150)]
    df = spark.createDataFrame([(i, s, i // 6 + (i > 80) * 4) for i, s in enumerate(sizes)], "i long, size long, block long")
    got = layout.fold(df, "block", ["i"], "size", threshold).orderBy("i").collect()
    assert [r["run"] for r in got] == plain_fold(sizes, threshold)
    assert [r["at"] for r in got] == [sum(sizes[:i]) for i in range(len(sizes))]


def test_small_blocks_give_the_same_layout(spark):
    rows = [(f"k{i % 40:02d}", i, 0, "v" * (i % 23)) for i in range(300)]
    df = records(spark, rows)
    for f, columns in ((layout.flush_runs, ["seq", "run"]), (layout.slices, ["key", "seq", "run"]), (layout.index_blocks, ["run", "key", "offset"])):
        assert sorted(f(df, 500, 300).select(columns).collect()) == sorted(f(df, 500).select(columns).collect())


def records(spark, rows):
    return spark.createDataFrame(rows, "key string, seq long, type byte, value string")


def test_slices_close_after_the_threshold(spark):
    size = 17 + 4 + 2
    got = layout.slices(records(spark, [(k, 1, 0, "v") for k in "abcde"]), size + 1)
    assert sorted((r["key"], r["run"]) for r in got.collect()) == [("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 2)]


def test_slices_never_split_a_key(spark):
    got = layout.slices(records(spark, [("alpha", 40, 0, ""), ("shared", 30, 0, ""), ("shared", 20, 1, ""), ("shared", 10, 0, ""), ("zulu", 0, 0, "")]), 30)
    runs = {}
    for r in got.collect():
        runs.setdefault(r["key"], set()).add(r["run"])
    assert runs == {"alpha": {0}, "shared": {0}, "zulu": {1}}


def test_index_blocks(spark):
    got = layout.index_blocks(records(spark, [(f"key-{i:02d}", i, 0, "v" * 1500) for i in range(12)])).orderBy("run").collect()
    assert [r["key"] for r in got] == ["key-00", "key-03", "key-06", "key-09"]
    size = 17 + 4 + 6 + 1500
    assert [r["offset"] for r in got] == [0, 3 * size, 6 * size, 9 * size]


def tables(spark, rows):
    return spark.createDataFrame(rows, "number long, level int, size long, min_key string, max_key string")


def test_level_zero_inputs_take_the_gap(spark):
    t = tables(spark, [(1, 0, 1, "a", "c"), (2, 0, 1, "x", "z"), (3, 1, 1, "e", "g"), (4, 1, 1, "zz", "zzz")])
    assert sorted(r["number"] for r in compaction.level_zero_inputs(t).collect()) == [1, 2, 3]


def test_overlap_is_inclusive(spark):
    t = tables(spark, [(1, 1, 1, "cc", "ee"), (2, 2, 1, "aa", "cc"), (3, 2, 1, "ee", "gg"), (4, 2, 1, "xx", "zz")])
    assert sorted(r["number"] for r in compaction.overlapping(t, t.where("number = 1"), 2).collect()) == [2, 3]


def test_next_table_goes_round(spark):
    t = tables(spark, [(1, 1, 1, "a", "b"), (2, 1, 1, "d", "e")])
    pick = lambda c: compaction.next_table(t, 1, c).first()["number"]
    assert [pick(None), pick("b"), pick("e")] == [1, 2, 1]


def test_budgets(spark):
    for size, over in ((1001, True), (1000, False)):
        assert compaction.level_sizes(tables(spark, [(1, 1, size, "a", "b")]), 1000).first()["over"] is over
    got = {r["level"]: (r["budget"], r["over"]) for r in compaction.level_sizes(tables(spark, [(1, 0, 9, "a", "b"), (2, 2, 10001, "a", "b")]), 1000).collect()}
    assert got == {0: (None, False), 2: (10000, True)}


def test_key_to_table(spark):
    t = tables(spark, [(10, 1, 1, "b", "d"), (11, 1, 1, "g", "k"), (12, 1, 1, "ma", "pz")])
    keys = spark.createDataFrame([(k,) for k in ["a", "b", "d", "dd", "e", "g", "k", "l", "m", "n", "o", "pa", "q"]], "key string")
    got = {r["key"]: r["number"] for r in plans.key_to_table(keys, t).collect()}
    assert got == {"a": None, "b": 10, "d": 10, "dd": None, "e": None, "g": 11, "k": 11, "l": None, "m": None, "n": 12, "o": 12, "pa": 12, "q": None}


def test_replace_tables(spark):
    t = tables(spark, [(1, 0, 1, "a", "b"), (2, 1, 1, "c", "d")])
    got = plans.replace_tables(t, spark.createDataFrame([(1,)], "number long"), tables(spark, [(5, 1, 1, "a", "b")]))
    assert sorted(r["number"] for r in got.collect()) == [2, 5]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, scalars.fnv1a_hex(F.lit("alpha"))) == "8ac625bb85ed202b"
    assert one(spark, scalars.fnv1a_hex(F.lit(""))) == "cbf29ce484222325"
    assert one(spark, scalars.bit_positions(F.lit("alpha"), 64, 1)) == [59]
    assert scalars.bloom_parameters(10000) == (95851, 7) and scalars.bloom_parameters(0) == (1, 1)
    assert one(spark, F.crc32(F.lit("123456789").cast("binary"))) == 0xCBF43926
    for name, number in {"sst_0.sst": 0, "sst_007.sst": 7, "sst_.sst": None, "sst_12x.sst": None, "tmp_sst_12.sst": None, "sst_12.sst.tmp": None}.items():
        assert one(spark, scalars.file_number(F.lit(name), "sst_", ".sst")) == number
    assert one(spark, scalars.table_path(F.lit("d"), F.lit(3))) == "d/sstable/sst_3.sst"
    assert one(spark, scalars.log_record(F.lit("k"), F.lit(7), F.lit(0), F.lit("é"))) == "P,7,1,k=2,é\n"


def test_record_image(spark):
    image = scalars.encode_record(F.lit("a"), F.lit(0x0102030405060708), F.lit(0), F.lit("xy"))
    assert bytes(one(spark, image)).hex() == "000807060504030201" + "01000000" + "02000000" + "617879"
    assert one(spark, scalars.record_checksum(F.lit("a"), F.lit(0x0102030405060708), F.lit(0), F.lit("xy"))) == 0xE6E80A76


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(1500).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"))
    bits, hashes = scalars.bloom_parameters(1500)
    filled = bloom.build(keys, bits, hashes).cache()
    assert bloom.probe(keys, filled, bits, hashes).where("not maybe").count() == 0
    absent = spark.range(4000).select(F.concat(F.lit("absent"), F.col("id").cast("string")).alias("key"))
    assert bloom.probe(absent, filled, bits, hashes).where("maybe").count() < 0.03 * 4000
    expected = {p for i in range(1500) for p in formats.positions(f"key{i}".encode(), bits, hashes)}
    assert {r["position"] for r in filled.collect()} == expected


def test_a_level_too_large_to_send(spark, monkeypatch):
    level = tables(spark, [(i, 1, 1, f"{i:03d}c", f"{i:03d}m") for i in range(0, 90, 2)])
    keys = spark.createDataFrame([(f"{i:03d}{c}",) for i in range(92) for c in "acgmz"] + [("",), (None,)], "key string")
    wide = tables(spark, [(1, 0, 1, "004a", "010a"), (2, 0, 1, "", "001"), (3, 0, 1, "070m", "080c"), (4, 0, 1, "088z", "zzz")])
    small = [sorted(map(str, f(a, level).collect())) for f, a in ((plans.key_to_table, keys), (plans.overlaps, wide))]
    monkeypatch.setattr(plans, "SENT_TABLES", 10)
    assert [sorted(map(str, f(a, level).collect())) for f, a in ((plans.key_to_table, keys), (plans.overlaps, wide))] == small
