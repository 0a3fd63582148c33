"""Benchmark decontamination by pigeonhole edit matching.

A test item of n bytes may be found with up to n // ERROR_BYTES edits. It is split into one piece more than that, so
that any match holds a piece unharmed; one automaton finds all pieces of all items in a document, and around each hit
Myers' bit-parallel distance looks for the whole item. Texts are compared as UTF-8 bytes with A-Z in lower case, whole
texts against all items.

The items go to the executors in blocks of about BLOCK_BYTES, dealt by a hash. The documents are scanned once for each
block, one after another: a block is on the driver and in a broadcast only while its scan runs, so that both are bounded
however large the benchmark is; one block holds a benchmark of some 30,000 items. A worker compiles a block once.

Defined results: null and empty texts match nothing; null and blank items are not searched for, all others are, whatever
their length (one of fewer than ERROR_BYTES bytes has to stand unchanged); texts of any length are searched whole;
repeated documents each return their matches, those with a null doc_id, too; items of one text return one match each;
empty tables give no rows; other columns are ignored. Of several places of an item in a document, the one with the fewest
edits counts, then the first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WORD_GAP, slices, staged, table

ERROR_BYTES = 12
BLOCK_BYTES = 8 << 20
SCHEMA = "doc_id long, item_id long, distance int, start long, end long"
_LOWER = LOWER.tobytes()


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 consecutive parts of nearly equal length and where they start."""
    edges = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Fewest edits between the pattern and a substring of text that ends at some place (and, anchored, begins where
    text does), and the first such end. Bit-parallel over the pattern."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score < best:
            best, end = score, i + 1
        ph = (ph << 1 | anchored) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best, end


class Matcher:
    """All items of one block, compiled."""

    def __init__(self, items: list[tuple[int, str]], error_bytes: int = ERROR_BYTES):
        import ahocorasick

        self.items = items
        self.edits = [len(t) // error_bytes for _, t in items]
        self.peq = [masks(t) for _, t in items]
        self.back = [masks(t[::-1]) for _, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            for at, piece in pieces(text, self.edits[k]):
                where.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best place of every item found in a text of one character a byte."""
        near: dict[int, list[int]] = {}
        for last, (size, uses) in self.automaton.iter(text):
            for k, at in uses:
                near.setdefault(k, []).append(last + 1 - size - at)
        out = []
        for k, starts in near.items():
            item, edits = self.items[k][1], self.edits[k]
            m, best = len(item), None
            starts.sort()
            lo = hi = starts[0]
            spans = []
            for s in starts[1:]:
                if s > hi + 2 * edits + m:
                    spans.append((lo, hi))
                    lo = s
                hi = s
            spans.append((lo, hi))
            for lo, hi in spans:
                begin = max(0, lo - edits)
                distance, end = myers(self.peq[k], m, text[begin : hi + m + edits])
                if distance <= edits and (best is None or distance < best[1]):
                    _, size = myers(self.back[k], m, text[max(0, begin + end - m - edits) : begin + end][::-1], anchored=True)
                    best = (k, distance, begin + end - size, begin + end)
            if best:
                out.append(best)
        return out


_COMPILED: dict[str, Matcher] = {}


def _matcher(name: str, items: list[tuple[int, str]], error_bytes: int) -> Matcher:
    """The compiled block, kept by a worker between its tasks."""
    if name not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[name] = Matcher(items, error_bytes)
    return _COMPILED[name]


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_bytes: int = ERROR_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance and the byte range of every item that a document holds."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.regexp_replace("text", WORD_GAP, "") != "")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") > 0)
    found = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == block)
        rows = [(r["item_id"], r["text"].encode().translate(_LOWER).decode("latin-1")) for r in part.collect()]
        if not rows:
            continue
        held, name = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held=held, name=name) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, held.value, error_bytes)
            for b in slices(batches, "text"):
                hits = []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    for k, distance, start, end in matcher.search(text.translate(_LOWER).decode("latin-1")):
                        hits.append((doc, matcher.items[k][0], distance, start, end))
                if hits:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "distance", "start", "end"])

        hits = texts.mapInArrow(run, SCHEMA)
        if blocks > 1:
            hits = staged(hits)
            held.destroy()
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
