"""The pipeline's line stage against brute force."""

import random

import corpus_pipeline
from test_dedup import WORD, brute_components, brute_lines, near_copies


def test_line_stage_against_brute_force(spark):
    rng = random.Random(4)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(30)]
    docs = [(d, "\n".join(rng.choices(lines, k=rng.randint(0, 4)))) for d in range(120)]
    docs += [(200, None), (201, ""), (202, " \n"), (203, "a shared line of words"), (204, "a shared line of words\nseven words that only stand here today"), (205, "a shared line of words\n \t")]
    df = spark.createDataFrame([(d, t, -1) for d, t in docs], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_stage(spark, df, "").collect()}
    assert got == {d: (t, len(t) if n else -1) for d, (t, n) in brute_lines(docs).items() if not n or WORD.search(t)}
    assert 204 in got and 205 not in got


def test_near_and_leak_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    items = [(i, " ".join(f"{chr(97 + i)}{rng.randint(0, 99)}" for _ in range(20))) for i in range(5)]
    docs = list(enumerate(near_copies(rng, 80)))
    docs = [(d, t + (" " + items[d % 5][1] if d % 4 == 0 else "")) for d, t in docs] + [(200, None), (201, ""), (None, items[0][1].upper())]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    near = corpus_pipeline.near_stage(spark, df, "")
    kept = {d for d, (_, _, stays) in brute_components([x for x in docs if x[0] is not None]).items() if stays} | {None}
    assert near.columns == df.columns and {r["doc_id"] for r in near.collect()} == kept
    left = corpus_pipeline.leak_stage(spark, df, str(tmp_path))
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {d for d, t in docs if not any(i in (t or "").lower() for _, i in items)}
