"""op7 and op8 against the tokenizers library."""

import random
import zlib
from collections import Counter as Bag

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelpie.llm import packing, token_counts
from kelpie.llm.common import text_buffer
from kelpie.llm.packing import Capacity, plan_bins

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "'ll", "'re", "'v", "é", "ñ", "1", "23", "!", "<|endoftext|>", "<|end", "日本", "😀", " ", " ", "-", "-" * 10, " " * 9, "ion", "tion", "Z", "\r\n", "̀", "½", "'S", "x" * 50, " " * 130, "'t"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def texts(n):
    rng = random.Random(5)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(n)] + ["", None, "a" * 9000, "ab" * 5000, " " * 5000, "-" * 7000 + "x", "q'sx'sd''s", "thequick" * 3000]


@pytest.mark.parametrize("chunk", [token_counts.CHUNK, 7])
def test_counts_are_the_library_s(library, monkeypatch, chunk):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    some = texts(3000 if chunk > 100 else 300)
    some = some if chunk > 100 else some[:300] + ["q'sx'sd''s", "ab" * 40]
    c = token_counts.Counter(VOCABULARY)
    got = c.counts(*text_buffer(pa.array(some, pa.string())))
    assert got.tolist() == [len(library.encode(t or "", add_special_tokens=False).ids) for t in some]


def test_maps_of_chunks_compose_to_the_serial_run(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 64)
    rng, scans = random.Random(8), []
    scan = token_counts.ChunkMaps.scan
    monkeypatch.setattr(token_counts.ChunkMaps, "scan", lambda *a: scans.append(1) or scan(*a))
    c = token_counts.Counter(VOCABULARY)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(5000))
    cases = ["a" * 20_000, "x" + "ab" * 9000, "q" + "abc" * 7000, "tion" * 5000 + " end", "  -" + "-=" * 8000, letters, cjk, "é" * 9001]
    for text in cases:
        scans.clear()
        assert c.counts(*text_buffer(pa.array([text], pa.string())))[0] == len(library.encode(text, add_special_tokens=False).ids)
        assert len(scans) <= 4  # of some 300 chunks in a run
    got = c.counts(*text_buffer(pa.array(cases + [None, " "] + cases, pa.string())))
    assert got.tolist() == [len(library.encode(t or "", add_special_tokens=False).ids) for t in cases + [None, " "] + cases]
    data, starts = np.frombuffer(letters.encode(), np.uint8), np.zeros(len(letters), bool)
    starts[[0, 500, 501, 900, 15_000]] = True
    state, total = 0, 0
    for byte, new in zip(data, starts, strict=True):
        to, emitted = c.transducer.advance(np.array([0 if new else state]), np.array([int(byte)]))
        state, total = int(to[0]), total + int(emitted[0])
    assert c.transducer.emissions(data, starts).sum() == total


def test_a_scan_stops_at_states_outside_a_map():
    maps = token_counts.ChunkMaps()
    maps.add(np.array([0 << 32 | 5, 0 << 32 | 7, 1 << 32 | 7]), np.array([7, 9, 5]), np.array([1, 2, 3]))
    kind, heads = np.array([0, 1, 0, 1, 0, 0, 1]), np.array([True, False, False, False, True, False, False])
    # Run one: 5 -> 7 -> 5 -> 7 -> 5; run two: 5 -> 7 -> 9, which the map of kind 1 does not have.
    assert maps.scan(kind, heads, np.full(7, 5)).tolist() == [7, 5, 7, 5, 7, 9, -1]


def test_a_full_table_starts_anew(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    c = token_counts.Counter(VOCABULARY)
    for t in texts(30)[:30]:
        assert c.counts(*text_buffer(pa.array([t], pa.string())))[0] == len(library.encode(t, add_special_tokens=False).ids)


def test_count_query_rows(spark, library):
    rows = [(0, "one two"), (1, None), (2, ""), (3, "x"), (3, "x"), (None, "y" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df, VOCABULARY).collect())
    assert got == sorted((d is None, d, len(t or ""), len(library.encode(t or "").ids)) for d, t in rows)
    assert token_counts.count_tokens(df.limit(0), VOCABULARY).count() == 0


def test_ids_are_the_library_s(library):
    for t in texts(3000):
        assert packing.document_ids(t, VOCABULARY).tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 2]


def place(moves):
    """length, rank -> bin and offset."""
    out = {}
    for length, lo, hi, first, per, at in moves:
        for r in range(lo, hi):
            assert (length, r) not in out
            out[length, r] = (first + (r - lo) // per, at + (r - lo) % per * length)
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [Capacity(100, 100, 10_000), Capacity(100, 3, 10_000), Capacity(100, 100, 3500)])
def test_plan_respects_every_capacity(rule, capacity):
    rng = random.Random(3)
    longest = int(min(capacity.tokens, capacity.cost**0.5))
    histogram = Bag(rng.randint(1, longest) if rng.random() < 0.7 else rng.randint(1, 5) for _ in range(3000))
    at = place(plan_bins(dict(histogram), capacity, rule))
    assert Bag(k[0] for k in at) == histogram
    bins = {}
    for (length, _), (b, offset) in at.items():
        bins.setdefault(b, []).append((offset, length))
    assert sorted(bins) == list(range(len(bins)))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity.tokens and len(pieces) <= capacity.docs and sum(n * n for _, n in pieces) <= capacity.cost
    if capacity == Capacity(100, 100, 10_000):
        assert len(bins) <= 1.01 * -(-sum(k * v for k, v in histogram.items()) // 100) + 1


def test_a_piece_above_a_capacity():
    with pytest.raises(ValueError):
        plan_bins({10: 1}, Capacity(100, 100, 50))
    assert plan_bins({}) == []


def test_packing(spark, library):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(PARTS, k=rng.randint(0, 60)))) for i in range(200)] + [(200, None), (201, ""), (202, "word " * 9000), (202, "word " * 9000), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit(1))
    out = packing.pack_documents(df, VOCABULARY, Capacity(64, 64, 4096)).collect()
    bins, docs = {}, {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append(r)
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) <= 1.02 * sum(r["length"] for r in out) / 64
    for d, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in docs[d]})
        assert [m[0] for m in mine] == list(range(len(mine))) and sum(m[2] for m in mine) == len(ids)
        for k, start, length, crc in mine:
            assert crc == zlib.crc32(ids[start : start + length].tobytes()) and (length == 64 or k == 0)
    assert len(docs[202]) == 2 * len({r["piece"] for r in docs[202]})
    assert packing.pack_documents(df.limit(0), VOCABULARY).count() == 0


def plain_best_fit(sizes, capacity):
    """Piece by piece, longest first: the bin with the least weighted norm of what would remain."""
    limit, weight, bins = np.array([capacity.tokens, capacity.docs, capacity.cost], float), np.array(capacity.weights), []
    for size in sorted(sizes, reverse=True):
        need = np.array([size, 1, size * size])
        fits = [b for b in bins if (b >= need).all()]
        if fits:
            least = min(fits, key=lambda b: (((b - need) / limit) ** 2 @ weight))
            least -= need
        else:
            bins.append(np.array([capacity.tokens, capacity.docs, capacity.cost]) - need)
    return len(bins)


@pytest.mark.parametrize("capacity", [Capacity(), Capacity(100, 4, 3000), Capacity(64, 64, 900), Capacity(50, 3, 2500)])
def test_as_few_bins_as_plain_best_fit(capacity):
    rng = random.Random(capacity.docs)
    top = min(capacity.tokens, int(capacity.cost**0.5))
    for n in (1, 7, 60, 400):
        sizes = [min(top, int(rng.paretovariate(0.7))) for _ in range(n)]
        moves = plan_bins(dict(Bag(sizes)), capacity)
        used = max(first + -(-(hi - lo) // per) for _, lo, hi, first, per, _ in moves)
        assert abs(used - plain_best_fit(sizes, capacity)) <= max(1, n // 50)
