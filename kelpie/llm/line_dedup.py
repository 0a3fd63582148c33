"""Line dedup by a deletion-neighbourhood join.

Lines are compared as sequences of words. A line with a word goes if an equal line stands earlier; one of at least
NEAR_WORDS words also goes if an earlier line of as many differs from it by one word replaced, inserted or deleted (in
shorter lines one word is too much of the line). Earlier is a smaller doc_id, then a smaller line number.

The neighbourhood of a line is the line itself and the line without each one of its words, as 128-bit keys with the
place of the deletion. Lines with one key and place differ by a replaced word; a whole line that equals another one's
deletion differs by an inserted word. Either way a key needs only its earliest line, found by a partial minimum, and no
pairs within a group; the edit distance to that line is then verified on the words.

Before, a pigeonhole join keeps only lines that share their first or second half with another text: with one edit, one
half stays whole. Only those emit neighbourhoods, so their number of keys follows the near copies, not the corpus.

Defined results: a null text returns as null, an empty one as empty, each with one line and none removed; rows with a
null doc_id come first in order, as one document; rows of one doc_id with different texts are documents of their own, in
the order of a hash of their texts; repeated rows are documents of one place: all of them keep the lines that the first
keeps; blank lines always stay; lines of any length are whole; an empty table gives no rows; other columns are carried
along by `dedup_lines`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import identity, mix, release, slices, staged, table, text_buffer, word_hashes, words

NEAR_WORDS = 10
LINE_SCHEMA = "doc_id long, tag long, line int, n int, k1 long, k2 long, halves array<long>"
NEIGHBOUR_SCHEMA = "v1 long, v2 long, place int, doc_id long, tag long, line int"
#: A line's place in the order of the corpus.
PLACE = ("doc_id", "tag", "line")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class LineHashes:
    """The words of every line of a buffer and 128-bit hashes of them: sums over words of a hash of word and place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        begin, end, row = words(data, offsets)
        breaks = np.flatnonzero(data == 10)
        number = np.searchsorted(breaks, begin)  # line breaks before each word
        key = row.astype(np.int64) * (len(data) + 1) + number
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.start, self.stop = first, np.r_[first[1:], len(key)] if len(first) else first
        self.row = row[first] if len(first) else first
        self.line = number[first] - np.searchsorted(breaks, offsets[self.row]) if len(first) else first
        self.n = self.stop - self.start
        nth = np.arange(len(begin)) - np.repeat(self.start, self.n)
        left = np.repeat(self.n, self.n) - nth
        sums = lambda w, place: np.r_[np.uint64(0), np.cumsum(mix(w + place.astype(np.uint64) * _STEP))]
        hashes = [word_hashes(data, begin, end, salt) for salt in (0, 1)]
        self.here = [sums(w, nth + 1) for w in hashes]
        self.moved = [sums(w, nth) for w in hashes]  # as if a word before were gone
        self.back = sums(hashes[0], left + 0x40000000)  # counted from the line's end

    @staticmethod
    def _finish(value: np.ndarray, n: np.ndarray) -> np.ndarray:
        return mix(value + n.astype(np.uint64) * np.uint64(0x51ED2701))

    def whole(self, which: int, line: np.ndarray) -> np.ndarray:
        s = self.here[which]
        return self._finish(s[self.stop[line]] - s[self.start[line]], self.n[line])

    def half(self, line: np.ndarray, length: np.ndarray, second: bool) -> np.ndarray:
        """The first or second half that a line shares with lines of `length` words or one more."""
        p = length // 2
        if second:
            value = self.back[self.stop[line]] - self.back[self.stop[line] - (length - p)]
        else:
            value = self.here[0][self.start[line] + p] - self.here[0][self.start[line]]
        return mix(value + length.astype(np.uint64) * np.uint64(2) + np.uint64(second))

    def without(self, which: int, line: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Key of the line without the word at `place`: that of the whole line which has these words."""
        here, moved, at = self.here[which], self.moved[which], self.start[line]
        value = (here[at + place] - here[at]) + (moved[self.stop[line]] - moved[at + place + 1])
        return self._finish(value, self.n[line] - 1)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id and tag as `identity` has them, and text."""
    doc_id, tag = identity()
    return docs.select(doc_id.alias("doc_id"), tag.alias("tag"), "text")


def line_keys(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """Every line with a word: its place, its key and the half keys of those with near_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h = LineHashes(*text_buffer(b.column("text")))
            at = np.arange(len(h.n))
            near = h.n >= near_words
            some = at[near]
            keys = np.stack([h.half(some, h.n[some] - back, second) for back in (0, 1) for second in (False, True)], 1)
            halves = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(4 * near)].astype(np.int32)), _long(keys.reshape(-1)))
            row = pa.array(h.row)
            yield pa.record_batch([b.column("doc_id").take(row), b.column("tag").take(row), pa.array(h.line.astype(np.int32)), pa.array(h.n.astype(np.int32)), _long(h.whole(0, at)), _long(h.whole(1, at)), halves], [*PLACE, "n", "k1", "k2", "halves"])

    return identified(docs).mapInArrow(run, LINE_SCHEMA)


def neighbourhoods(lines: DataFrame) -> DataFrame:
    """Keys of each line (doc_id, tag, line, text) and of the line without each of its words; place -1 is the whole line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            h = LineHashes(*text_buffer(b.column("text")))  # each text is one line
            every = np.arange(len(h.n))
            line = np.repeat(every, h.n)
            place = np.arange(len(line)) - np.repeat(h.start, h.n)
            all_lines, places = np.r_[every, line], np.r_[np.full(len(every), -1), place]
            v = [np.r_[h.whole(i, every), h.without(i, line, place)] for i in (0, 1)]
            row = pa.array(h.row[all_lines])
            yield pa.record_batch([_long(v[0]), _long(v[1]), pa.array(places.astype(np.int32)), *(b.column(c).take(row) for c in PLACE)], ["v1", "v2", "place", *PLACE])

    return lines.select(*PLACE, "text").mapInArrow(run, NEIGHBOUR_SCHEMA)


def within_one_edit(a: list, b: list) -> bool:
    """Whether two sequences differ by at most one replacement, insertion or deletion."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def _suspects(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Place and text of the first of each of the lines that share a half with another text."""
    halves = lines.select("k1", "k2", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select("half")
    suspects = halves.join(shared, "half", "left_semi").select("k1", "k2").distinct()
    firsts = lines.where(F.size("halves") > 0).groupBy("k1", "k2").agg(F.min(F.struct(*PLACE)).alias("first")).join(suspects, ["k1", "k2"], "left_semi")
    wanted = firsts.groupBy("first.doc_id", "first.tag").agg(F.collect_set("first.line").alias("lines"))
    texts = identified(docs).join(wanted.hint("merge"), ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"])
    return texts.select("doc_id", "tag", F.explode("lines").alias("line"), F.split("text", "\n", -1).alias("all")).select(*PLACE, F.get("all", F.col("line")).alias("text"))


def _links(near: DataFrame) -> DataFrame:
    """me and early, two places each: the earliest line whose neighbourhood meets that of a later line."""
    me = F.struct(*PLACE)
    by_place = near.groupBy("v1", "v2", "place").agg(F.min(me).alias("early"), F.max(me).alias("late"))
    replaced = near.where("place >= 0").join(by_place.where("place >= 0 and early <> late").drop("late"), ["v1", "v2", "place"]).where(me > F.col("early")).select(me.alias("me"), "early")
    whole = by_place.where("place = -1").select("v1", "v2", F.col("early").alias("short"))
    longer = near.where("place >= 0").join(whole, ["v1", "v2"])
    inserted = longer.where(me > F.col("short")).select(me.alias("me"), F.col("short").alias("early"))
    deleted = longer.where(me < F.col("short")).select(F.col("short").alias("me"), me.alias("early"))
    return replaced.unionByName(inserted).unionByName(deleted).groupBy("me").agg(F.min("early").alias("early"))


def _verified(links: DataFrame, texts: DataFrame) -> DataFrame:
    """Places of the later lines that are within one edit of their earlier one."""
    mine = texts.select(F.struct(*PLACE).alias("me"), F.col("text").alias("mine"))
    theirs = texts.select(F.struct(*PLACE).alias("early"), F.col("text").alias("theirs"))
    pairs = links.join(mine, "me").join(theirs, "early").select("me.*", "mine", "theirs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = lambda t: t.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ")
        for x in batches:
            rows = zip(x.column("mine").cast(pa.binary()).to_pylist(), x.column("theirs").cast(pa.binary()).to_pylist(), strict=True)
            yield x.select(list(PLACE)).filter(pa.array([within_one_edit([w for w in split(m) if w], [w for w in split(t) if w]) for m, t in rows], pa.bool_()))

    return pairs.mapInArrow(verify, "doc_id long, tag long, line int")


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """k1, k2 of the lines within one edit of an earlier line. lines: a stored table as line_keys makes it."""
    texts = staged(_suspects(docs, lines))
    near = staged(neighbourhoods(texts))
    links = staged(_links(near))
    release(near)
    found = staged(_verified(links, texts).join(lines.select(*PLACE, "k1", "k2"), list(PLACE)).select("k1", "k2").distinct())
    release(texts, links)
    return found


def removed_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id and tag (see `identified`) and the numbers of the lines that go."""
    lines = staged(line_keys(docs, near_words))
    near = near_lines(docs, lines)
    copies = staged(_copies(lines, near))
    gone = staged(_removed(lines, copies))
    release(near, copies, lines)
    return gone


def _copies(lines: DataFrame, near: DataFrame) -> DataFrame:
    """k1, k2 of the lines that stand more than once or near an earlier one; near ones go everywhere."""
    me = F.struct(*PLACE)
    copies = lines.groupBy("k1", "k2").agg(F.min(me).alias("first"), F.max(me).alias("last")).where("first <> last").select("k1", "k2", "first")
    return copies.join(near.withColumn("near", F.lit(True)), ["k1", "k2"], "full_outer").select("k1", "k2", "first", F.coalesce("near", F.lit(False)).alias("near"))


def _removed(lines: DataFrame, copies: DataFrame) -> DataFrame:
    me = F.struct(*PLACE)
    hits = lines.select(*PLACE, "k1", "k2").join(copies.hint("merge"), ["k1", "k2"]).where(F.col("near") | (me > F.col("first")))
    return hits.groupBy("doc_id", "tag").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs with text without the lines that go, and n_lines and n_removed (columns of these names are replaced).

    The joins with the documents are merge joins at every size: what goes is not bounded.
    """
    gone = removed_lines(docs, near_words).select(F.col("doc_id").alias("of_doc"), F.col("tag").alias("of_tag"), "gone").hint("merge")
    doc_id, tag = identity()
    rows = docs.select(F.struct(*docs.columns).alias("row"), doc_id.alias("d"), tag.alias("t"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    out = rows.join(gone, (F.col("d") == F.col("of_doc")) & (F.col("t") == F.col("of_tag")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    new = {"text": text, "n_lines": F.size("lines").cast("long"), "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
