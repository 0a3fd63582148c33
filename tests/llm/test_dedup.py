"""op5, op9 and op10 against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelpie.llm import line_dedup, near_dedup, suffix_dedup
from kelpie.llm.common import text_buffer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- line dedup


def brute_lines(docs):
    gone, seen = collections.defaultdict(set), []
    for d, text in sorted(docs, key=lambda x: x[0]):
        for i, line in enumerate((text or "").split("\n")):
            w = WORD.findall(line)
            if not w:
                continue
            near = len(w) >= line_dedup.NEAR_WORDS
            if any(w == v or (near and len(v) >= line_dedup.NEAR_WORDS and line_dedup.within_one_edit(w, v)) for v in seen):
                gone[d].add(i)
            seen.append(w)
    return {d: ("\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[d]) if gone[d] else t, len(gone[d])) for d, t in docs}


def edited(rng, words):
    words = list(words)
    for _ in range(rng.randint(0, 3)):
        r, i = rng.random(), rng.randrange(len(words) + 1)
        if r < 0.4 and i < len(words):
            words[i] = rng.choice("abcdefghxyz")
        elif r < 0.6:
            words.insert(i, rng.choice("abcxyz"))
        elif r < 0.8 and i < len(words):
            del words[i]
    return words


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(3, 14))] for _ in range(25)]
    docs = [(d, "\n".join(rng.choice([" ", "  ", "\t"]).join(edited(rng, rng.choice(base))) for _ in range(rng.randint(0, 6)))) for d in range(150)]
    docs += [(200, None), (201, ""), (202, "\n\n"), (203, ("long " * 5000 + "\n") * 3)]
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("line", "gone", "k1", "place")})
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(docs)


def test_repeated_rows_and_empty_tables(spark):
    line = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, line), (1, line), (2, line + "\nrest"), (None, line)], DOCS)
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(False, None, line, 0), (True, 1, "", 1), (True, 1, "", 1), (True, 2, "rest", 1)]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    line, other, near = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    copy = near.replace("c3", "changed")
    rows = [(1, line), (2, line), (2, other), (3, near), (4, other + "\nx"), (5, copy), (None, copy), (6, "x\n\n \nunlike")]
    for parts in (1, 5):
        got = {(r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(parts)).collect()}
        assert got == {(1, line, 0), (2, "", 1), (2, other, 0), (3, "", 1), (4, "x", 1), (5, "", 1), (None, copy, 0), (6, "\n \nunlike", 1)}


def test_line_keys_do_not_depend_on_structure():
    """Thue-Morse lines, which collide under polynomial hashes modulo 2**64."""
    a = ["a"]
    while len(a) < 4096:
        a += ["b" if x == "a" else "a" for x in a]
    lines = [" ".join(a), " ".join("b" if x == "a" else "a" for x in a), "".join(a), "".join("b" if x == "a" else "a" for x in a)]
    h = line_dedup.LineHashes(*text_buffer(pa.array(lines)))
    assert len({(int(h.whole(0, np.array([i]))[0]), int(h.whole(1, np.array([i]))[0])) for i in range(4)}) == 4


# ---- near dedup


def shingle_set(text):
    w = WORD.findall(lower(text))
    return set(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(docs):
    sets, root = {d: shingle_set(t) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in names}


def near_copies(rng, n_docs):
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(12)]
    out = []
    for _ in range(n_docs):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 1 + len(w) // 15)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(rng.choice([str.upper, str.lower])(rng.choice([" ", "\n", " \t"]).join(w)))
    return out


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 7])
def test_components_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    docs = [(i * 3 + 1, t) for i, t in enumerate(near_copies(random.Random(9), 250))] + [(0, None), (5000, ""), (5001, " \n"), (5002, "a b c"), (5003, "A  B c"), (5004, "a b")]
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("id", "key", "label", "sketch", "size")})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_components(df).collect()}
    assert got == brute_components(docs)


def test_near_dedup_keeps_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(4, text), (2, text), (2, text), (3, text + " end"), (9, ""), (None, text)], DOCS)
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in near_dedup.near_dedup(df).collect()) == [(False, None), (True, 2), (True, 2), (True, 9)]
    assert near_dedup.near_components(df.limit(0)).count() == 0


def test_near_copies_of_rows_that_share_an_id(spark):
    rng = random.Random(12)
    one, two, three = (" ".join(rng.choices([f"w{i}" for i in range(300)], k=60)) for _ in range(3))
    rows = [(2, one), (2, two), (3, one + " end"), (4, two + " end"), (5, three), (5, three), (6, three + " x"), (None, three), (7, "")]
    for parts in (1, 4):
        got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_components(spark.createDataFrame(rows, DOCS).repartition(parts)).collect()), key=str)
        assert got == sorted([(2, 2, True), (2, 2, True), (3, 2, False), (4, 2, False), (5, 5, True), (5, 5, True), (6, 5, False), (None, None, True), (7, 7, True)], key=str)


def test_links_at_the_limit(spark):
    """Pairs of a similarity just at 0.75 and just below it, with texts long enough for thousands of shingles."""
    rng, rows, want = random.Random(5), [], {}
    for i in range(60):
        w = [f"{i}of{j}" for j in range(1000)]
        n, low = 996, i % 2  # 996 shingles; five go with each word changed, far apart
        shared = 0.75 * 2 * n / 1.75  # this many in common are just enough
        changes = int((n - shared) / 5) + low
        other = list(w)
        for j in rng.sample(range(10, 980, 6), changes):
            other[j] = "new"
        a, b = shingle_set(" ".join(w)), shingle_set(" ".join(other))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
        want[2 * i + 1] = 2 * i if 100 * len(a & b) >= 75 * len(a | b) else 2 * i + 1
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert {d: got[d] for d in want} == want and 20 <= sum(d != c for d, c in want.items()) <= 40


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    one, two, three = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 1))
    values, at = np.concatenate([one[:400], one[200:], two, three]), np.array([0, 400, 800, 1000, 1001])
    s = near_dedup.sketches(values, at, 512)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.09 and (s[0] == s[2]).mean() < 0.02
    assert len(set(s[3].tolist())) > 1  # a single element fills every bin
    assert (near_dedup.sketches(values[::-1].copy(), np.array([0, 1, 201, 601, 1001]), 512)[2] == s[1]).all()


# ---- suffix dedup


def brute_suffix(docs, length):
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda x: x[0]):
        data = (text or "").encode()
        covered = bytearray(len(data) + 1)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for i in range(len(data)) if covered[i] and (i == 0 or not covered[i - 1]))
        out[d] = (len(data), sum(covered), runs, hashlib.sha256(bytes(c for c, x in zip(data, covered, strict=False) if not x)).hexdigest())
    return out


@pytest.mark.parametrize("length, k, shard", [(20, 7, 1 << 20), (20, 7, 300), (100, 24, 1 << 20)])
def test_spans_against_brute_force(spark, monkeypatch, length, k, shard):
    rng = random.Random(length)
    base = ["".join(rng.choices("abé ", k=rng.randint(10, 2 * length))) for _ in range(12)]
    docs = [(d, "".join(rng.choice(base) if rng.random() < 0.7 else "".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 9)))) for d in range(120)]
    docs += [(200, None), (201, ""), (202, "a" * 300), (203, "ab" * 200 + "c" + "a" * 120), (204, "\0" * 250)]
    monkeypatch.setattr(suffix_dedup.shard_spans, "__defaults__", (length, shard))
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("anchor", "at", "spans", "first")})
    out = suffix_dedup.remove_repeats(df, length, k).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["h"]) for r in out.collect()} == brute_suffix(docs, length)


def test_sharded_groups_give_the_same_spans():
    rng = random.Random(5)
    base = "".join(rng.choices("abcdef", k=400))
    group = []
    for d in range(60):
        at = rng.randint(0, 250)
        text = list(base[at : at + rng.randint(20, 60)])
        text[rng.randrange(len(text))] = rng.choice("abcdef")
        group.append((1, d, at, "".join(text).encode()))
    def bytes_of(spans):
        return {(d, i) for d, a, b in spans for i in range(a, b)}

    whole = suffix_dedup.shard_spans(group, 20, 1 << 20)
    assert bytes_of(whole) and bytes_of(suffix_dedup.shard_spans(group, 20, 200)) == bytes_of(whole)


def test_common_prefixes_against_plain_ones():
    rng = random.Random(17)
    base = "".join(rng.choices("ab", k=120)).encode()
    contexts = [base[i : i + rng.randint(9, 60)] + bytes(rng.choices(b"ab", k=rng.randint(0, 3))) for i in (0, 0, 3, 8, 11, 16, 40, 41, 60) for _ in range(4)]
    wide = b"".join(bytes(x + 1 for x in c) + b"\0" for c in contexts)
    ends = np.cumsum([len(c) + 1 for c in contexts])
    starts = ends - [len(c) + 1 for c in contexts]
    stop, text, wanted = np.repeat(ends, ends - starts), np.frombuffer(wide, np.uint8), np.ones(len(wide), bool)
    order = suffix_dedup.suffix_array(text, stop, wanted)
    got = suffix_dedup.common_prefixes(text, order, starts, ends, wanted)

    def shared(i, j):
        n = 0
        while n < min(stop[i] - i, stop[j] - j) and wide[i + n] == wide[j + n]:
            n += 1
        return n

    suffixes = [wide[i : stop[i]] for i in order]
    assert suffixes == sorted(suffixes)
    assert got.tolist() == [0, *(shared(i, j) for j, i in zip(order, order[1:]))]


def test_contexts_alone_under_their_anchor_are_left_out():
    one, two = (bytes(random.Random(n).choices(b"abcdef", k=40)) for n in (1, 2))
    spans = suffix_dedup.shard_spans([(1, 5, 0, one), (2, 6, 0, two), (2, 7, 9, two[:30]), (3, 8, 0, one)], 20)
    assert spans == [(7, 9, 39)]  # anchors are functions of the window, so equal windows have one


def test_kept_ranges():
    assert suffix_dedup.kept_ranges(10, [(2, 4), (3, 5), (5, 6), (8, 10)]) == ([(0, 2), (6, 8)], 6, 2)
    assert suffix_dedup.kept_ranges(0, []) == ([], 0, 0) and suffix_dedup.kept_ranges(3, []) == ([(0, 3)], 0, 0)


def test_no_documents(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("slices_of", [1, 2])
def test_repeated_rows_keep_a_copy(spark, slices_of):
    rng = random.Random(8)
    one, two = ("".join(rng.choices("abcdefgh ", k=400)) for _ in range(2))
    docs = [(1, one), (2, two + one[50:250]), (3, one[:120] + one[:120])]
    df = spark.createDataFrame([x for x in docs for _ in range(2)], DOCS).repartition(slices_of)
    out = suffix_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    got = sorted((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["h"])) for r in out.collect())
    assert got == sorted(x for x in brute_suffix(docs, suffix_dedup.LENGTH).items() for _ in range(2))


def test_spans_of_rows_that_share_an_id(spark):
    rng = random.Random(13)
    one, two, three = ("".join(rng.choices("abcdefgh ", k=300)) for _ in range(3))
    rows = [(1, one), (2, two), (2, three), (3, two + "#" + three), (None, one), (None, one), (4, None)]
    for parts in (1, 4):
        out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(parts)).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in out) == [("1", 300, 300, 1), ("2", 300, 0, 0), ("2", 300, 0, 0), ("3", 601, 600, 2), ("4", 0, 0, 0), ("None", 300, 0, 0), ("None", 300, 0, 0)]


@pytest.mark.parametrize("segment", [1, 7, 64])
def test_anchors_do_not_depend_on_segments(monkeypatch, segment):
    rng = random.Random(3)
    texts = ["a" * 90, "".join(rng.choices("ab", k=200)), "short", "".join(rng.choices("abcdef", k=150))]
    buffer = text_buffer(pa.array(texts))
    whole = suffix_dedup.anchors(*buffer, 20, 7)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    assert all((x == y).all() for x, y in zip(whole, suffix_dedup.anchors(*buffer, 20, 7), strict=True))


def test_one_place_twice_is_no_repeat():
    text = bytes(range(97, 123)) * 5
    assert suffix_dedup.shard_spans([(1, 4, 7, text), (1, 4, 7, text)], 100) == []
