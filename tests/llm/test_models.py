"""op2, op4, op6 and the pipeline: exact counts, probabilities that add up, held-out accuracy, edit distances."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kelpie.llm import decontaminate, pitman_yor, quality_classifier
from kelpie.llm.common import mix, staged, table, text_buffer, training_fold, word_hashes
from kelpie.llm.decontaminate import Matcher

DOCS = "doc_id long, text string"
FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")

# ---- language model


def corpus(n=120):
    rng = random.Random(2)
    english, french = [f"en{i}" for i in range(60)], [f"fr{i}x" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(rng.choices(english if i % 2 else french, weights, k=rng.randint(1, 60)) + ([f"rare{i}"] if i % 3 else []))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "Fr1x FR1X unseen")]


def test_language_model(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("part", "word", "learn", "score")})
    out = {r["doc_id"]: r for r in pitman_yor.score_documents(df, training_fold() != 1, part_bytes=2000).collect()}
    tokens = {d: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for d, t in docs}
    counts = collections.Counter()
    for d, t in tokens.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    assert len(out) == len(docs)
    better = 0
    for d, t in tokens.items():
        r = out[d]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in counts for w in t), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
        better += r["score"] > r["base_score"]
    assert better > 0.9 * len(docs)


class Restaurant:
    """Dishes of one restaurant or of many, seated customer by customer; tables are lists of sizes."""

    def __init__(self, counts, seeds, d):
        self.counts, self.seeds, self.d, self.sweeps = counts, seeds, d, 0
        self.where = {x: [None] * min(n, pitman_yor.GROUPS) for x, n in counts.items()}
        self.sizes = {x: [0] * 64 for x in counts}

    def sweep(self, opening):
        for x, n in self.counts.items():
            sizes, where = self.sizes[x], self.where[x]
            for j in range(len(where)):
                weight = n // len(where) + (j < n % len(where))
                if where[j] is not None:
                    sizes[where[j]] -= weight
                free = sizes.index(0)
                pull = [opening(x) if k == free else s - self.d if s else 0 for k, s in enumerate(sizes)]
                left = float(pitman_yor.uniform(np.array([self.seeds[x]], np.uint64), self.sweeps, j)[0]) * sum(pull)
                where[j] = next(k for k, _ in enumerate(pull) if sum(pull[: k + 1]) > left)
                sizes[where[j]] += weight
        self.sweeps += 1

    def tables(self, x):
        return sum(s > 0 for s in self.sizes[x])


def hash_of(word):
    if word in (None, ""):
        return int(pitman_yor.END if word is None else pitman_yor.START)
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def brute_parent(counts, burn, keep):
    """Probability of a word, of which `counts` has the customers."""
    n, v = sum(counts.values()), len(counts)
    d = pitman_yor.discount_of(sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values()))
    room = Restaurant(counts, {w: hash_of(w) for w in counts}, d)
    total, chance = v, collections.Counter()
    for s in range(burn + keep):
        weight = (1 + d * total) / (v + 1)
        room.sweep(lambda x: weight)  # noqa: B023
        total = sum(room.tables(w) for w in counts)
        if s >= burn:
            for w in [*counts, "never seen"]:
                chance[w] += (counts.get(w, 0) - d * (room.tables(w) if w in counts else 0) + (1 + d * total) / (v + 1)) / (1 + n) / keep
    return lambda w: chance[w if w in counts else "never seen"]


def brute_scores(tokens, learn):
    """log10 probability of every text; tokens: lists that end with None."""
    pairs = collections.Counter()
    for d, t in tokens.items():
        if learn(d):
            pairs.update(zip(["", *t], t, strict=False))
    d = pitman_yor.discount_of(sum(n == 1 for n in pairs.values()), sum(n == 2 for n in pairs.values()))
    p = brute_parent(collections.Counter(w for _, w in pairs), *pitman_yor.FIRST_SWEEPS)
    seeds = {(u, w): int(pitman_yor.pair_seed(np.array([hash_of(u)], np.uint64), np.array([hash_of(w)], np.uint64))[0]) for u, w in pairs}
    room, total = Restaurant(pairs, seeds, d), collections.Counter(u for u, _ in pairs)
    tables, totals, size = collections.Counter(), collections.Counter(), collections.Counter()
    for (u, _), n in pairs.items():
        size[u] += n
    for s in range(pitman_yor.BURN + pitman_yor.KEEP):
        room.sweep(lambda x: (1 + d * total[x[0]]) * p(x[1]))  # noqa: B023
        total = collections.Counter()
        for x in pairs:
            total[x[0]] += room.tables(x)
        if s >= pitman_yor.BURN:
            totals.update(total)
            tables.update({x: room.tables(x) for x in pairs})
    sent = collections.Counter()
    for x in pairs:
        sent[x[1]] += room.tables(x)
    p, keep = brute_parent(sent, *pitman_yor.LAST_SWEEPS), pitman_yor.KEEP
    chance = lambda u, w: (pairs[u, w] - d * tables[u, w] / keep + (1 + d * totals[u] / keep) * p(w)) / (1 + size[u])
    return {i: sum(math.log10(chance(u, w)) for u, w in zip(["", *t], t, strict=False)) for i, t in tokens.items()}


@pytest.mark.parametrize("part, shard", [(2000, 900), (1 << 20, 1 << 20)])
def test_scores_against_brute_force(spark, part, shard):
    docs = corpus(90) + [(2000, "en0 en1 " * 40), (2001, "Tail " + "y" * 300), (2002, "tail " + "y" * 300)]
    tokens = {d: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for d, t in docs}
    want = brute_scores(tokens, lambda d: zlib.crc32(str(d).encode()) % 5 != 1)
    out = pitman_yor.score_documents(spark.createDataFrame(docs, DOCS), training_fold() != 1, part, shard)
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_language_model_without_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    assert pitman_yor.score_documents(df.limit(0), F.lit(True)).count() == 0
    untrained = {r["doc_id"]: r for r in pitman_yor.score_documents(df, F.lit(False)).collect()}
    assert untrained[1]["n_known"] == 0 and untrained[1]["train_tokens"] == 0 and untrained[1]["score"] == 0


def test_repeated_and_unnamed_rows(spark):
    df = spark.createDataFrame([(1, "a b c")] * 2 + [(None, "a b c"), (None, None), (3, "x")], DOCS)
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["score"], 9)) for r in pitman_yor.score_documents(df, F.col("doc_id") < 3).collect())
    assert sum(got.values()) == 5 and max(got.values()) == 2 and len({x[3] for x in got if x[1] == 4}) == 1


def test_rare_words_are_contexts(spark):
    rng = random.Random(6)
    rare = [f"{i}of{j}xx" for i in range(40) for j in range(40)]
    follows = dict(zip(rare, rng.sample(rare, len(rare)), strict=True))
    docs = [(i, f"{x} {follows[x]}") for i, x in enumerate(rare * 3)]
    heard = [(10000 + i, f"{x} {follows[x]}") for i, x in enumerate(rare[:300])]
    mixed = [(20000 + i, f"{x} {follows[rare[i + 1]]}") for i, x in enumerate(rare[:300])]
    df = spark.createDataFrame(docs + heard + mixed, DOCS)
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score_documents(df, F.col("doc_id") < 10000, part_bytes=20000, shard_bytes=30000).collect()}
    assert sum(got[10000 + i] > got[20000 + i] + 0.5 for i in range(300)) > 295


def test_seating():
    """Sweeps leave as many tables as the dish's distribution, p(t) in proportion to S(n, t) * opening**t, has on average."""
    n, d, a = 6, 0.4, 1.3
    ways = [1.0]  # generalised Stirling numbers of n customers at t tables
    for i in range(n):
        ways = [0.0] + [(ways[t - 1] if t else 0) + (i - t * d) * (ways[t] if t < len(ways) else 0) for t in range(1, i + 2)]
    weight = [x * a**t for t, x in enumerate(ways)]
    seating = pitman_yor.Seating(np.full(20000, n), mix(np.arange(20000, dtype=np.uint64)), d)
    for _ in range(12):
        t = seating.sweep(np.full(20000, a))
    assert t.mean() == pytest.approx(sum(k * x for k, x in enumerate(weight)) / sum(weight), rel=0.02)
    big = pitman_yor.Seating(np.array([1, 2, 10**6]), np.arange(3, dtype=np.uint64), d)
    t = big.sweep(np.full(3, a))
    assert t[0] == 1 and 1 <= t[1] <= 2 and 1 <= t[2] <= pitman_yor.GROUPS


def brute_joint_scores(tokens, learn):
    """As brute_scores, but every customer moves on its own, restaurants count their tables as they open and close, and
    the tables of each sweep are the parent's customers in the next one."""
    pairs, size = collections.Counter(), collections.Counter()
    for i, t in tokens.items():
        if learn(i):
            pairs.update(zip(["", *t], t, strict=False))
            size.update(["", *t[:-1]])
    d = pitman_yor.discount_of(sum(n == 1 for n in pairs.values()), sum(n == 2 for n in pairs.values()))
    p = brute_parent(collections.Counter(w for _, w in pairs), *pitman_yor.FIRST_SWEEPS)
    often = {x: n for x, n in pairs.items() if n > 1}
    room = Restaurant(often, {(u, w): int(pitman_yor.pair_seed(np.array([hash_of(u)], np.uint64), np.array([hash_of(w)], np.uint64))[0]) for u, w in often}, d)
    total = collections.Counter(u for u, w in pairs if pairs[u, w] == 1)
    kept = []
    for s in range(pitman_yor.BURN + pitman_yor.KEEP):
        for width in (2**k for k in range(1, 11)):
            for j in range(width):
                then = total.copy()
                for x in [x for x, n in often.items() if width // 2 < n <= width and j < n]:
                    sizes, where, before = room.sizes[x], room.where[x], room.tables(x)
                    if s:
                        sizes[where[j]] -= 1
                    free = sizes.index(0)
                    pull = [(1 + d * then[x[0]]) * p(x[1]) if k == free else c - d if c else 0 for k, c in enumerate(sizes)]
                    left = float(pitman_yor.uniform(np.array([room.seeds[x]], np.uint64), s, j)[0]) * sum(pull)
                    where[j] = next(k for k, _ in enumerate(pull) if sum(pull[: k + 1]) > left)
                    sizes[where[j]] += 1
                    total[x[0]] += room.tables(x) - before
        tables = {x: room.tables(x) if x in often else 1 for x in pairs}
        sent = collections.Counter()
        for x, t in tables.items():
            sent[x[1]] += t
        p = brute_parent(sent, *pitman_yor.FIRST_SWEEPS)
        if s >= pitman_yor.BURN:
            kept.append((tables, total.copy(), p))
    one = lambda u, w, tables, total, p: (pairs[u, w] - d * tables.get((u, w), 0) + (1 + d * total[u]) * p(w)) / (1 + size[u])
    chance = lambda u, w: sum(one(u, w, *x) for x in kept) / len(kept)
    return {i: sum(math.log10(chance(u, w)) for u, w in zip(["", *t], t, strict=False)) for i, t in tokens.items()}


def test_joint_scores_against_brute_force(spark, tmp_path, monkeypatch):
    docs = corpus(90) + [(2000, "en0 en1 " * 40), (2001, "Tail " + "y" * 300), (2002, "tail " + "y" * 300)]
    tokens = {d: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for d, t in docs}
    df = spark.createDataFrame(docs, DOCS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    query = {r["doc_id"]: r["score"] for r in pitman_yor.op2_pitman_yor(spark, str(tmp_path)).collect()}
    parts = {r["doc_id"]: r["score"] for r in pitman_yor.score_documents(df, training_fold() != 1, 2000, 900, joint=True).collect()}
    monkeypatch.setattr(pitman_yor, "GROUPS", 1024)
    want = brute_joint_scores(tokens, lambda d: zlib.crc32(str(d).encode()) % 5 != 1)
    assert query == pytest.approx(want, rel=1e-9) and parts == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("singly", [20, 1024])
def test_seating_of_many_customers(monkeypatch, singly):
    """Tables of dishes of 100 customers that move singly, as rows or as crowds, against their distribution."""
    monkeypatch.setattr(pitman_yor, "SINGLY", singly)
    n, d, a = 100, 0.5, 12.0
    ways = np.array([1.0])  # of i customers at t tables, times a**t, scaled
    for i in range(n):
        t = np.arange(i + 2)
        stay = np.r_[ways * np.maximum(i - t[:-1] * d, 0), 0.0]
        ways = (stay + np.r_[0.0, ways * a]) / (i + a)
    want = (ways * np.arange(n + 1)).sum() / ways.sum()
    seating = pitman_yor.Seating(np.full(40, n), mix(np.arange(40, dtype=np.uint64)), d, singly=True)
    means = [seating.sweep(np.full(40, a)).mean() for _ in range(50)]
    assert want > 15 and np.mean(means[20:]) == pytest.approx(want, rel=0.03)


def test_turns_go_on_from_the_last_one(monkeypatch):
    monkeypatch.setattr(pitman_yor, "SINGLY", 40)
    rng = np.random.default_rng(1)
    context, n = rng.integers(0, 5, 400), rng.integers(2, 90, 400)
    seed, parent, singles = mix(np.arange(400, dtype=np.uint64)), rng.random(400) / 50, np.arange(5) * 3
    state, order = {}, rng.permutation(400)
    other = {}
    whole = pitman_yor.Seating(n, seed, 0.5, True, context)
    total = singles.copy()

    def moved(at, gained):
        np.add.at(total, context[at], gained)

    for _ in range(3):
        tables, totals, state = pitman_yor.move_contexts(context, n, seed, parent, singles, 0.5, state)
        shuffled, _, other = pitman_yor.move_contexts(context[order], n[order], seed[order], parent[order], singles, 0.5, other)
        assert totals.tolist() == (singles + np.bincount(context, tables)).tolist()
        assert tables.tolist() == whole.sweep(lambda at: (1 + 0.5 * total[context[at]]) * parent[at], moved).tolist()
        assert total.tolist() == totals.tolist() and shuffled.tolist() == tables[order].tolist()
    assert (tables <= n).all() and tables[n > 40].max() > 5


def test_crowds_move_side_by_side():
    """The rounds of a sweep do not grow with the number of large dishes."""
    rng = np.random.default_rng(3)
    n = rng.integers(1025, 4000, 300)
    seating = pitman_yor.Seating(n, mix(np.arange(300, dtype=np.uint64)), 0.6, True)
    asked, gained = [], np.zeros(300, np.int64)

    def opening(at):
        asked.append(len(at))
        return np.full(len(at), 9.0)

    first = seating.sweep(opening, lambda at, k: np.add.at(gained, at, k)).copy()
    assert max(asked) == 300 and gained.tolist() == first.tolist()
    asked.clear()
    tables = seating.sweep(opening, lambda at, k: np.add.at(gained, at, k))
    assert len(asked) == pitman_yor.CROWD and gained.tolist() == tables.tolist()
    assert [int(x.sum()) for x in seating.crowd_sizes] == n.tolist() and all((x > 0).all() for x in seating.crowd_sizes)
    alone = pitman_yor.Seating(n[5:6], seating.seed[5:6], 0.6, True)
    for _ in range(2):
        alone.sweep(np.array([9.0]))
    assert alone.crowd_sizes[0].tolist() == seating.crowd_sizes[5].tolist()


def test_crowds_of_a_restaurant(monkeypatch):
    """Crowds whose new tables raise each other's weights, against the same dishes whose customers move singly."""
    context, n = np.repeat(np.arange(40), 6), np.tile([40, 60, 80, 100, 120, 140], 40)
    seed, means = mix(np.arange(240, dtype=np.uint64)), []
    for singly in (1024, 20):
        monkeypatch.setattr(pitman_yor, "SINGLY", singly)
        seating, total = pitman_yor.Seating(n, seed, 0.5, True, context), np.zeros(40, np.int64)
        assert len(seating.crowds) == (240 if singly == 20 else 0)
        runs = [seating.sweep(lambda at: (1 + 0.5 * total[context[at]]) * 0.12, lambda at, k: np.add.at(total, context[at], k)).sum() for _ in range(80)]  # noqa: B023
        assert total.sum() == runs[-1]
        means.append(np.mean(runs[40:]) / 240)
    assert 4 < means[0] and means[1] == pytest.approx(means[0], rel=0.1)


def test_large_crowds_as_small_ones(monkeypatch):
    """Both ways to move a crowd lead to the same number of tables."""
    monkeypatch.setattr(pitman_yor, "SINGLY", 20)
    means = []
    for throng in (0, 1 << 15):
        monkeypatch.setattr(pitman_yor, "THRONG", throng)
        seating = pitman_yor.Seating(np.full(40, 100), mix(np.arange(40, dtype=np.uint64)), 0.5, True)
        means.append(np.mean([seating.sweep(np.full(40, 12.0)).mean() for _ in range(40)][20:]))
    assert means[0] > 15 and means[1] == pytest.approx(means[0], rel=0.03)


def test_lanes_choose_as_plain_rows(monkeypatch):
    rng = np.random.default_rng(4)
    n, seed = rng.integers(129, 1025, 80), mix(np.arange(80, dtype=np.uint64))
    found = []
    for lane in (32, 1024):  # 1024: never used
        monkeypatch.setattr(pitman_yor, "LANE", lane)
        seating = pitman_yor.Seating(n, seed, 0.7, True)
        found.append([seating.sweep(np.full(80, 30.0)).tolist() for _ in range(3)] + [seating.dump()])
    assert found[0] == found[1] and max(found[0][2]) > 64


@pytest.mark.parametrize("singly", [False, True])
def test_parent_goes_on_from_its_last_sweep(monkeypatch, singly):
    monkeypatch.setattr(pitman_yor, "SINGLY", 100)
    c, word = np.array([1, 2, 3, 30, 33, 70, 99, 300]), mix(np.arange(8, dtype=np.uint64))
    parent, whole, state = pitman_yor.Parent(int(c.sum()), 8, 1, 1, singly), pitman_yor.Seating(c, word, pitman_yor.discount_of(1, 1), singly), {}
    for s in range(4):
        want = whole.sweep(np.full(8, parent.opening(s))).tolist()
        tables, state = parent.sweep(word, c, state)
        assert tables.tolist() == want
        parent.totals.append(int(tables.sum()))


def test_parent_of_stored_counts(spark, tmp_path):
    """Every sweep starts from what the one before it left, and the averages are those of the plain version."""
    rng = random.Random(9)
    counts = {f"w{i}": rng.choice([1, 1, 2, 5, 40, 200]) for i in range(60)}
    spark.createDataFrame([(hash_of(w) - (hash_of(w) >> 63 << 64), n) for w, n in counts.items()], "word long, c long").repartition(3).write.parquet(f"{tmp_path}/counts")
    parent, p = pitman_yor.seat_words(spark.read.parquet(f"{tmp_path}/counts"), 1, 2, 4)
    got = {r["word"] % 2**64: r["p"] for r in p.collect()}
    want = brute_parent(counts, 1, 2)
    assert got == pytest.approx({hash_of(w): want(w) for w in counts}, rel=1e-9) and parent.unseen(2) == pytest.approx(want("never seen"), rel=1e-9)
    assert sum(got.values()) + parent.unseen(2) == pytest.approx(1) and len(parent.totals) == 4


# ---- classifier


def test_passages_cover_whole_texts():
    text = "abc\n" * 300
    x, first = quality_classifier.encode(*text_buffer(pa.array([text, None, "", "x" * 512, "x" * 513], pa.string())))
    assert first.tolist() == [0, 3, 4, 5, 6, 8] and x[3, -1] == x[4, -1] == 1 and x[0, -1] == 0


def test_gradients():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, quality_classifier.FEATURES)).astype(np.float32)
    first, y = np.array([0, 3, 4, 9, 12]), np.array([0, 1, 1, 0])
    before = quality_classifier.fit(x, first, y, epochs=1).score(x, first)
    after = quality_classifier.fit(x, first, y, epochs=80).score(x, first)
    loss = lambda p: -np.mean(np.log(np.where(y == 1, p, 1 - p)))
    assert loss(after) < 0.1 and loss(after) < loss(before) / 1.5


def test_constant_models(spark):
    docs, none = spark.createDataFrame([(1, "a"), (2, None)], DOCS), spark.createDataFrame([], "doc_id long, quality int")
    model = quality_classifier.train(docs, none)
    assert [r["score"] for r in quality_classifier.score_documents(docs, model).collect()] == [0.5, 0.5]
    assert quality_classifier.keep_good(docs.withColumn("x", F.lit(1)), model).count() == 2
    ones = quality_classifier.train(docs, spark.createDataFrame([(1, 1), (2, 1), (2, None)], "doc_id long, quality int"))
    assert ones.constant == 1.0 and quality_classifier.score_documents(docs.limit(0), ones).count() == 0


@needs_data
def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    out = quality_classifier.op4_quality_classifier(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert docs.count() == 1000 and sum(r["predicted"] == r["quality"] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)


# ---- decontamination


def brute_distance(p, t):
    col = list(range(len(p) + 1))
    best = len(p)
    for c in t:
        new = [0]
        for i in range(1, len(p) + 1):
            new.append(min(col[i] + 1, new[i - 1] + 1, col[i - 1] + (p[i - 1] != c)))
        col, best = new, min(best, new[-1])
    return best


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_matches_are_those_of_brute_force():
    rng = random.Random(1)
    pick = lambda lo, hi: "".join(rng.choices("abcd", k=rng.randint(lo, hi)))
    found = 0
    for _ in range(150):
        p = pick(20, 80)
        q = list(p)
        for _ in range(rng.randint(0, len(p) // decontaminate.ERROR_BYTES + 2)):
            i = rng.randrange(len(q))
            q[i : i + rng.randint(0, 1)] = rng.choices("abcd", k=rng.randint(0, 2))
            q = q or ["a"]
        t = pick(0, 80) + "".join(q) + pick(0, 80)
        d, got = brute_distance(p, t), Matcher([(7, p)]).search(t)
        assert bool(got) == (d <= len(p) // decontaminate.ERROR_BYTES)
        for _, distance, start, end in got:
            found += 1
            assert distance == d == levenshtein(p, t[start:end])
    assert found > 50


def test_leaks(spark):
    item = "what is the answer to this very long question about the café"
    docs = [(1, "x " + item.upper().replace("É", "é") + " y"), (2, item.replace("answer", "answar")), (3, "nothing"), (4, None), (5, ""), (1, item), (None, item), (6, item[:30]), (7, "a Short one"), (8, "shor t")]
    items = [(10, item), (11, item), (12, None), (13, "short"), (14, ""), (15, " \t")]
    df = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for block in (1 << 20, 70):
        got = collections.Counter((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(df, bench, block_bytes=block).collect())
        assert got == {(d, i, e): n for d, e, n in ((1, 0, 2), (2, 1, 1), (None, 0, 1)) for i in (10, 11)} | {(7, 13, 0): 1}
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0 and decontaminate.find_leaks(df.limit(0), bench).count() == 0


# ---- pipeline


@needs_data
def test_pipeline_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, FOLDER))
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and kept <= ids, name
        ids = kept
    assert len(ids) > 100
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).select("doc_id").collect()} == ids


def test_pipeline_takes_odd_documents(spark, tmp_path):
    good = "The cat sat on the mat and looked at the door for a while."
    rows = [(1, good, "en", "s", len(good)), (2, good, "en", "s", len(good)), (3, None, None, None, None), (4, "", "en", "s", 0), (5, good + "\nAnother line that only stands in this one document, with enough words to stay.", "en", None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for n, rows in (("some", rows), ("none", [])):
        folder = str(tmp_path / n)
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "an item of the benchmark that no document holds")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
        assert got == ({1, 3, 4, 5} if rows else set())


def test_attention_against_plain_loops():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(9, quality_classifier.FEATURES)).astype(np.float32)
    first = np.array([0, 1, 4, 9])
    model = quality_classifier.fit(x, first, np.array([0, 1, 1]), epochs=5)
    p, want = {k: v.astype(float) for k, v in model.weights.items()}, []
    for a, b in zip(first, first[1:], strict=False):
        hidden = [np.tanh(((r - model.mean) / model.scale) @ p["w"] + p["b"]) for r in x[a:b].astype(float)]
        pull = [math.exp(sum(t * g * c for t, g, c in zip(np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"]))), p["a"], strict=True))) for h in hidden]
        bag = sum(w * h for w, h in zip(pull, hidden, strict=True)) / sum(pull)
        want.append(1 / (1 + math.exp(-(bag @ p["c"] + p["d"]))))
    assert model.score(x, first) == pytest.approx(want, rel=1e-4)
