"""Goldens of merge, newest version, snapshots, ranges and probes."""

from pyspark.sql import functions as F

from kelpie.operators import changelog, compaction, reads

RECORD = "key string, seq long, type byte, value string"


def log(spark, *rows):
    return spark.createDataFrame([(k, s, t, v) for k, s, t, v in rows], RECORD)


def pairs(df):
    return [(r["key"], r["seq"]) for r in df.collect()]


def test_merge_keeps_all_versions_newest_first(spark):
    a = log(spark, ("alpha", 50, 0, "middle"), ("alpha", 10, 0, "oldest"), ("gamma", 50, 0, "gamma"))
    b = log(spark, ("alpha", 90, 0, "newest"), ("beta", 25, 0, "kept"), ("delta", 40, 0, "also"))
    empty = log(spark)
    assert pairs(reads.merge([a, empty, b])) == [("alpha", 90), ("alpha", 50), ("alpha", 10), ("beta", 25), ("delta", 40), ("gamma", 50)]


def test_latest_hides_tombstones(spark):
    rows = log(spark, ("alpha", 30, 0, "new"), ("alpha", 20, 0, "old"), ("beta", 40, 0, "deleted"), ("beta", 35, 1, ""), ("gamma", 50, 0, "new"), ("gamma", 45, 1, ""), ("hidden", 60, 1, ""), ("hidden", 10, 0, "old"))
    assert sorted(pairs(reads.latest(rows))) == [("alpha", 30), ("beta", 40), ("gamma", 50)]
    assert pairs(reads.tombstones(rows)) == [("hidden", 60)]
    assert ("hidden", 10) in pairs(reads.latest(rows, 50))


def test_snapshot_filter(spark):
    rows = log(spark, ("k", 90, 0, ""), ("k", 50, 0, ""), ("k", 10, 0, ""), ("a", 90, 0, ""), ("b", 50, 0, ""))
    assert sorted(pairs(reads.at_sequence(rows, 60))) == [("b", 50), ("k", 10), ("k", 50)]


def test_scan_bounds(spark):
    rows = log(spark, *[(k, i, 0, k) for i, k in enumerate(["alpha", "beta", "delta", "gamma"])])
    keys = lambda a, b: [k for k, _ in pairs(reads.scan(rows, a, b))]
    assert keys("beta", "gamma") == ["beta", "delta"]
    assert keys("gamma", "gamma") == keys("z", "a") == keys("alpha", "") == []


def test_scan_pushes_key_and_sequence_to_parquet(spark, tmp_path):
    log(spark, ("a", 1, 0, "x")).write.parquet(str(tmp_path / "t"))
    plan = reads.scan(spark.read.parquet(str(tmp_path / "t")), "a", "b", 5)._jdf.queryExecution().executedPlan().toString()
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "GreaterThanOrEqual(key,a)" in pushed and "LessThan(key,b)" in pushed and "LessThanOrEqual(seq,5)" in pushed and "type" not in pushed.split("PushedFilters")[1].split("ReadSchema")[0]


def test_retain(spark):
    rows = log(spark, *[("alpha", s, 0, "") for s in (90, 70, 50, 10)], ("beta", 80, 1, ""), ("beta", 60, 0, ""), ("beta", 20, 0, ""), ("gamma", 40, 0, ""), ("gamma", 30, 0, ""))
    assert sorted(pairs(compaction.retain(rows, 60))) == [("alpha", 50), ("alpha", 70), ("alpha", 90), ("beta", 60), ("beta", 80), ("gamma", 40)]
    rows = log(spark, ("alpha", 90, 0, ""), ("alpha", 50, 0, ""), ("beta", 80, 1, ""), ("beta", 40, 0, ""))
    assert sorted(pairs(compaction.retain(rows, 100))) == [("alpha", 90), ("beta", 80)]


def test_multi_get_is_tri_state(spark):
    rows = log(spark, ("a", 1, 0, "x"), ("b", 2, 0, "y"), ("b", 3, 1, ""))
    probes = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    got = {r["key"]: (r["state"], r["value"]) for r in reads.multi_get(rows, probes).collect()}
    assert got == {"a": ("VALUE", "x"), "b": ("TOMBSTONE", None), "c": ("ABSENT", None)}


def test_as_of(spark):
    rows = log(spark, ("a", 1, 0, "x"), ("a", 5, 1, ""), ("a", 9, 0, "z"))
    probes = spark.createDataFrame([(0, "a", 0), (1, "a", 1), (2, "a", 5), (3, "a", None), (4, "q", 9)], "id long, key string, read_seq long")
    got = {r["id"]: (r["state"], r["seq"], r["value"]) for r in reads.as_of(rows, probes, "id").collect()}
    assert got == {0: ("ABSENT", None, None), 1: ("VALUE", 1, "x"), 2: ("TOMBSTONE", None, None), 3: ("VALUE", 9, "z"), 4: ("ABSENT", None, None)}


def test_sequences_follow_operation_order_across_blocks(spark):
    ops = spark.createDataFrame([(i * 7, "remove" if i % 3 == 0 else "put", f"k{i}", "v") for i in range(50)], "op_idx long, op string, key string, value string")
    got = sorted((r["seq"], r["key"], r["type"], r["value"]) for r in changelog.assign_sequence(ops, 10, block=40).collect())
    assert got == [(11 + i, f"k{i}", int(i % 3 == 0), "" if i % 3 == 0 else "v") for i in range(50)]


def test_last_write_wins(spark):
    df = spark.createDataFrame([("a", 1, "x", 0), ("a", 1, "y", 1), ("a", 2, "z", 2)], "key string, seq long, value string, at long")
    assert sorted((r["key"], r["seq"], r["value"]) for r in changelog.last_write_wins(df, "at").collect()) == [("a", 1, "y"), ("a", 2, "z")]


def test_history(spark):
    rows = log(spark, ("a", 1, 0, "x"), ("a", 5, 1, ""))
    assert sorted((r["seq"], r["version"], r["replaced_at"]) for r in reads.history(rows).collect()) == [(1, 2, 5), (5, 1, None)]


def test_binary_order(spark):
    keys = [b"", b"\x7f", b"\x80", b"\xff", b"e\0f", b"line\nkey"]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary").withColumns({"seq": F.lit(1), "type": F.lit(0), "value": F.lit("")})
    assert [bytes(r["key"]) for r in reads.merge([df]).collect()] == sorted(keys)
