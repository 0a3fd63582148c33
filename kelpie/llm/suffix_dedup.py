"""Exact substring dedup with suffix arrays.

Every byte goes that is covered by a LENGTH-byte string which also starts earlier (smaller doc_id, or the same document
and an earlier start). Texts are UTF-8 bytes and strings never cross documents.

1. Anchors. The anchor of a window of LENGTH bytes is the first of its K-byte strings with the smallest hash, a function
   of the window's bytes alone, so equal windows have equal anchors. Windows of one anchor occurrence stand in a row.
   Occurrences of anchors that occur once are left out: their windows cannot repeat.
2. Contexts. For each other occurrence, the bytes of its windows. Equal contexts of one batch become one at once, with
   the earliest place, so that a hot anchor reaches the shuffle as a few rows from each task; there they become one as
   they are read, so a task holds the distinct contexts of an anchor only.
3. Shards. Contexts are dealt by anchor, in shards of about SHARD_BYTES (a context that is alone under its anchor has
   none to share windows with and takes no place there). Each gets a suffix array by Larsson-Sadakane
   refinement (ranks of 8-byte prefixes, doubled while groups are unsorted), common prefixes by Kasai's scan (all
   contexts side by side), and so its classes of windows equal in LENGTH bytes with their earliest places. Where one
   anchor's contexts fill several shards, these are merged by binary search among their sorted window classes.
4. A window that also starts earlier covers its bytes; covered runs of a document are joined and cut out of its text.

Defined results: null and empty texts have nothing to remove (a null text counts as empty); repeated rows are one place,
and all of them keep what the first keeps; rows of one doc_id with different texts are documents of their own, in the
order of a hash of their texts; rows with a null doc_id come first, likewise; texts of any length are whole; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, identity, mix, release, slices, staged, table, text_buffer

LENGTH = 100
K = 24
SHARD_BYTES = 1 << 20
#: Windows that are scanned at once.
SEGMENT = 1 << 24


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best over each w consecutive values, by doubling."""
    size = 1
    while size * 2 <= w:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def _chosen(data: np.ndarray, w: int, k: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Place (data starts at `at`) and hash of the anchor of every window."""
    rolling = Rolling(data)
    h = (rolling.sums[k:] - rolling.sums[:-k]) * rolling.inverse[: len(data) - k + 1]
    low = np.uint64((1 << 28) - 1)  # the place stands in for the hash's low bits: the first smallest wins
    chosen = (_sliding((h & ~low) | np.arange(len(h), dtype=np.uint64), w, np.minimum) & low).astype(np.int64)
    return chosen + at, h[chosen]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last window start (in the row) and hash of every anchor occurrence of a buffer of texts."""
    w = length - k + 1
    if len(data) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    pieces = [_chosen(data[i : i + SEGMENT + length - 1], w, k, i) for i in range(0, len(data) - length + 1, SEGMENT)]
    chosen, hashes = (np.concatenate(x) for x in zip(*pieces, strict=True))
    edge = np.zeros(len(data) + 1, np.int32)  # windows do not cross a text's end
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(edge, offsets[1:], -1)
    open_ = np.cumsum(edge[: len(chosen)]) == 0
    new = np.r_[True, (chosen[1:] != chosen[:-1]) | ~open_[:-1]]
    first = np.flatnonzero(new & open_)
    stop = np.flatnonzero(np.r_[(new | ~open_)[1:], True] & open_)
    row = np.searchsorted(offsets, first, "right") - 1
    return row, first - offsets[row], stop - offsets[row], mix(hashes[first])


def suffix_array(text: np.ndarray, stop: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Order of the wanted suffixes of text, each ending with the first zero in it (before stop), equal ones by place.

    Larsson-Sadakane: ranks by 8 symbols first; then groups of equal rank, and they alone, are sorted by the rank of
    what follows, the prefix compared doubling each time. A round takes only the places whose ranks later rounds look up.
    Rank, following rank and place share one word where they fit.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    key, going = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(8):
        symbol = padded[i : i + n] * going
        going &= symbol != 0
        key = (key << np.uint64(8)) | symbol.astype(np.uint64)
    order = np.argsort(key)  # ties are put right below
    key = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(n), 0))
    bits, longest = int(n).bit_length(), int((stop - np.arange(n)).max())
    depths, needs = [8], [wanted]
    while depths[-1] < longest:
        depths.append(depths[-1] * 2)
    for h in depths[-2::-1]:  # ranks of depth h serve those of depth 2 h at their own place and h further on
        further = np.zeros(n, bool)
        further[h:] = needs[0][: n - h]
        needs.insert(0, needs[0] | further)
    for h, need in zip(depths[:-1] or [8], needs[1:] or [wanted], strict=False):
        order = order[need[order]]
        group = rank[order]
        head = np.r_[True, group[1:] != group[:-1]][: len(group)]
        todo = np.flatnonzero(~(head & np.r_[head[1:], True][: len(head)]))
        if not len(todo):
            continue
        at, group = order[todo], group[todo]
        after = np.where(at + h < stop[at], rank[np.minimum(at + h, n - 1)] + 1, 0)
        if 3 * bits <= 62:
            word = np.sort((group << (2 * bits)) | (after << bits) | at)
            at, word = word & ((1 << bits) - 1), word >> bits
        else:
            perm = np.lexsort((at, after, group))
            at, word = at[perm], (group[perm] << bits) | after[perm]
        order[todo] = at
        index, group = np.arange(len(at)), word >> bits
        begin = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], index, 0))
        first = np.maximum.accumulate(np.where(np.r_[True, word[1:] != word[:-1]], index, 0))
        rank[at] = group + first - begin
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Kasai's scan: symbols that each suffix of order shares with the one before it, at most to the end of either's
    context. The wanted suffixes are the first ones of each context (starts..ends); the scan runs over all contexts side
    by side, the count falling by one a step while the other suffix's successor is wanted, too. Eight symbols are compared
    at once."""
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)] = text
    eight = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))
    place = np.zeros(len(text) + 1, np.int64)
    place[order] = np.arange(len(order))
    wanted = np.r_[wanted, False]
    stop = np.repeat(ends, ends - starts)  # of the context of each symbol
    out = np.zeros(len(order), np.int32)
    count_of = np.add.reduceat(wanted[:-1].astype(np.int64), starts) if len(starts) else starts
    lanes = np.argsort(-count_of, kind="stable")  # most windows first
    begin, size = starts[lanes], count_of[lanes]
    shared = np.zeros(len(lanes), np.int64)
    for step in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -step, "left"))
        i = begin[:live] + step
        r = place[i]
        j = np.where(r > 0, order[r - 1], -1)
        room = np.where(j >= 0, np.minimum(stop[i] - i, stop[j] - j), 0)
        count = np.minimum(np.maximum(shared[:live] - 1, 0), room)
        grow = np.flatnonzero(count < room)
        while len(grow):
            c = count[grow]
            differ = eight[i[grow] + c] ^ eight[j[grow] + c]
            lowest = (differ & (~differ + np.uint64(1))).astype(np.float64)  # a power of two, so its exponent is exact
            more = np.where(differ == 0, 8, (np.frexp(lowest)[1] - 1) >> 3)
            c = np.minimum(c + more, room[grow])
            count[grow] = c
            grow = grow[(differ == 0) & (c < room[grow])]
        out[r] = count
        shared[:live] = np.where(wanted[j + 1], count, 0)
    return out


class Shard:
    """Window classes of some contexts: what equals what in `length` bytes.

    contexts: bytes of at least `length`, in the order of their places; of two equal windows under one anchor the one
    in the earlier context is the earlier one.
    """

    def __init__(self, contexts: list[bytes], numbers: np.ndarray, length: int = LENGTH):
        sizes = np.array([len(c) for c in contexts], np.int64)
        text = np.frombuffer(b"".join(contexts), np.uint8)
        ends = np.cumsum(sizes) + np.arange(len(contexts))
        starts = ends - sizes
        # Bytes are shifted by one and a zero follows each context, so that no suffix runs into the next one.
        wide = np.zeros(len(text) + len(contexts), np.uint8)
        wide[np.arange(len(text)) + np.repeat(np.arange(len(contexts)), sizes)] = text + 1  # UTF-8 has no byte 255
        context = np.repeat(np.arange(len(contexts)), sizes + 1)
        window = ends[context] - np.arange(len(wide)) >= length  # one starts here
        at = suffix_array(wide, np.repeat(ends + 1, sizes + 1), window)
        head = common_prefixes(wide, at, starts, ends + 1, window) < length
        head[:1] = True
        self.group = np.cumsum(head) - 1
        self.context, self.offset = context[at], at - starts[context[at]]
        self.number = numbers[self.context]
        first = np.flatnonzero(head)
        self.least = np.minimum.reduceat(self.number, first) if len(first) else first
        self.wide, self.first, self.length = wide, at[first], length

    def keys(self) -> np.ndarray:
        """The bytes of every class, in order."""
        view = np.lib.stride_tricks.sliding_window_view(self.wide, self.length)[self.first]
        return np.ascontiguousarray(view).view(f"S{self.length}").reshape(-1)

    def merge(self, other: Shard) -> None:
        """Lets both shards know the earliest contexts of the classes that they share."""
        if not len(self.first) or not len(other.first):
            return
        mine, theirs = self.keys(), other.keys()
        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        b = np.flatnonzero(mine[at] == theirs)
        self.least[at[b]] = other.least[b] = np.minimum(self.least[at[b]], other.least[b])

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """Context number and offset of each window that stands in an earlier context too."""
        later = self.number > self.least[self.group]
        return self.number[later], self.offset[later]


def shard_spans(group: list[tuple], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[tuple]:
    """Covered spans (document, start, end) among contexts (key, document, start, bytes) of one or more whole anchor groups.

    A document is anything that sorts in the order of the corpus.
    """
    spans, contexts, places = [], [], []
    seen: dict[tuple, tuple] = {}  # place of each distinct context
    for key, doc, begin, text in sorted(group, key=lambda r: (r[0], r[1], r[2])):
        if (key, text) in seen:  # earlier as a whole, or the same place of a repeated row
            if seen[key, text] != (doc, begin):
                spans.append((doc, begin, begin + len(text)))
            continue
        seen[key, text] = (doc, begin)
    distinct = Counter(key for key, _ in seen)
    for (key, text), place in seen.items():
        if distinct[key] > 1:  # the windows of one context differ, as they hold its one anchor at different places
            contexts.append(text)
            places.append(place)
    if not contexts:
        return spans
    shards, part, size = [], 0, 0
    for i, c in enumerate(contexts):
        if size and size + len(c) > shard_bytes:
            shards.append(Shard(contexts[part:i], np.arange(part, i), length))
            part, size = i, 0
        size += len(c)
    shards.append(Shard(contexts[part:], np.arange(part, len(contexts)), length))
    for i, a in enumerate(shards):
        for b in shards[i + 1 :]:
            a.merge(b)
    for s in shards:
        number, offset = s.repeated()
        if len(number):
            perm = np.argsort(number * (1 << 32) + offset)
            number, offset = number[perm], offset[perm]
            new = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (offset[1:] > offset[:-1] + length)])
            stop = np.r_[new[1:], len(number)] - 1
            for n, lo, hi in zip(number[new].tolist(), offset[new].tolist(), offset[stop].tolist(), strict=True):
                doc, begin = places[n]
                spans.append((doc, begin + lo, begin + hi + length))
    return spans


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, tag and text, and rid: one number for doc_id and tag."""
    doc_id, tag = identity()
    return docs.select(doc_id.alias("doc_id"), tag.alias("tag"), "text").withColumn("rid", F.xxhash64("doc_id", "tag"))


def _repeated_anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """rid, first, last, anchor of the anchor occurrences whose anchor occurs again."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 18):
            row, first, last, h = anchors(*text_buffer(b.column("text")), length, k)
            yield pa.record_batch([b.column("rid").take(pa.array(row)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(h.view(np.int64))], ["rid", "first", "last", "anchor"])

    found = staged(docs.select("rid", "text").mapInArrow(scan, "rid long, first int, last int, anchor long"))
    again = staged(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))  # stored, so that a hot anchor can be split in the join
    out = staged(found.join(again.hint("merge"), "anchor", "left_semi"))
    release(again, found)
    return out


SPAN = "key long, doc_id long, tag long, start int, stop int, bytes binary"


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """doc_id, tag and spans array<struct<start, stop>>: the byte ranges, unordered and overlapping, that stand earlier
    too."""
    docs = _identified(docs).where(F.octet_length("text") >= length)
    kept = _repeated_anchors(docs, length, k)
    by_doc = kept.groupBy("rid").agg(F.collect_set(F.struct("first", "last", "anchor")).alias("at"))  # repeated rows have one place
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            text = b.column("text").cast(pa.binary()).to_pylist()
            docs_, at = list(zip(b.column("doc_id").to_pylist(), b.column("tag").to_pylist(), strict=True)), b.column("at")
            sizes = np.diff(np.asarray(at.offsets))
            firsts, lasts, keys = (np.asarray(at.flatten().field(i)) for i in range(3))
            rows, best, which = [], {}, np.repeat(np.arange(len(text)), sizes).tolist()
            for i, first, last, key in zip(which, firsts.tolist(), lasts.tolist(), keys.tolist(), strict=True):
                piece = text[i][first : last + length]
                me = (docs_[i], first)
                old = best.get((key, piece))
                if me == old:  # a repeated row: the same place
                    continue
                if old is None or me < old:
                    best[key, piece] = me
                    me = old
                if me is not None:  # covered as a whole; dealt by document
                    rows.append(((me[0][0] * 0x9E3779B97F4A7C15 ^ me[0][1]) & 0x7FFFFFFFFFFFFFFF, *me[0], me[1], me[1] + len(piece), None))
            rows += [(key, *doc, first, first + len(piece), piece) for (key, piece), (doc, first) in best.items()]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["key", "doc_id", "tag", "start", "stop", "bytes"])

    contexts = docs.join(by_doc, "rid").select("doc_id", "tag", "text", "at").mapInArrow(cut, SPAN).repartition("key").sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple] = {}  # earliest place of each distinct context of the anchors at hand
        last, size = None, 0

        def out(spans):
            rows = [(*doc, start, stop) for doc, start, stop in spans]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:5], strict=True)], ["doc_id", "tag", "start", "stop"])

        def shard():
            return shard_spans([(key, *place, piece) for (key, piece), place in best.items()], length)

        for b in batches:
            spans = []
            for key, doc, tag, start, stop, piece in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                if key != last and size > SHARD_BYTES:
                    spans += shard()
                    best, size = {}, 0
                last = key
                if piece is None:
                    spans.append(((doc, tag), start, stop))
                    continue
                me = ((doc, tag), start)
                old = best.get((key, piece))
                size += len(piece)  # copies count, so that shards of few distinct bytes stay small
                if old is None:
                    best[key, piece] = me
                elif me != old:  # the later one is covered as a whole; equal places are a repeated row
                    best[key, piece], later = min(me, old), max(me, old)
                    spans.append((*later, later[1] + len(piece)))
            if spans:
                yield out(spans)
        if best and (spans := shard()):
            yield out(spans)

    spans = contexts.mapInArrow(compare, "doc_id long, tag long, start int, stop int")
    found = staged(spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    release(kept)
    return found


def kept_ranges(size: int, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int, int]:
    """What spans leave of 0..size, the bytes that go and the number of maximal runs of them."""
    kept, at, gone, runs, end = [], 0, 0, 0, -1
    for start, stop in sorted(spans):
        if start > end:  # touching runs are one
            runs += 1
            if start > at:
                kept.append((at, start))
        gone += max(0, stop - max(start, at))
        at = max(at, stop)
        end = at
    if at < size:
        kept.append((at, size))
    return kept, gone, runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and `kept`, the bytes that are left (they may cut a character in two)."""
    spans = repeated_spans(docs, length, k).select(F.col("doc_id").alias("of_doc"), F.col("tag").alias("of_tag"), "spans")
    doc_id, tag = identity()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", doc_id.alias("d"), tag.alias("t"))
    joined = rows.join(spans, (F.col("d") == F.col("of_doc")) & (F.col("t") == F.col("of_tag")), "left").select("doc_id", "text", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = []
            for doc, text, at in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
                text = text or b""
                kept, gone, runs = kept_ranges(len(text), [(x["start"], x["stop"]) for x in at or ()])
                rows.append((doc, len(text), gone, runs, b"".join(text[i:j] for i, j in kept)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
