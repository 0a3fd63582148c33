"""MinHash near-dedup on fast similarity sketches.

A document's set is its distinct 5-word shingles (A-Z in lower case; with fewer words the whole sequence is one).
Documents with a Jaccard similarity of 0.75 or more are linked, and a component keeps its smallest doc_id.

1. Sketch. Fast similarity sketching: in round i every shingle throws a hashed value i + v into a hashed bin, the
   smallest stays, and rounds go on until every bin is filled; from round T on, round i fills bin i - T outright, so
   2 T rounds always suffice. Most documents need one or two rounds.
2. Equal sets become one representative before anything else.
3. Banding. BANDS bands of ROWS bins; documents alone in all their bands leave. With 32 bands of 5 a pair at 0.75 is
   missed with a probability below 0.0002, one at 0.8 below 0.00001.
4. In a bucket the sketches' agreement estimates the similarity. `forest` takes from each bucket a spanning forest of
   its likeliest links, so a bucket of n gives fewer than n pairs. They are verified on the full sets and components
   are made of the true links. `rest` then takes every pair of a bucket that is still in different components and whose
   set sizes allow the similarity. Sets of up to SMALL members are compared there in 16 bits a member, which can only
   find too much in common, so no link is lost; of larger ones, pairs are taken that a sketch of LONG bins does not put
   five standard deviations below the limit (a pair at 0.75 is lost so with a probability below 0.000001).
5. Verification deals pairs in parts of bounded size; a set travels once to each part that needs it, not once for each
   pair.

Hot buckets: a bucket above BLOCK members is cut into blocks. Each block has a forest of its own; as a document's blocks
differ from band to band, the forests join over the bands. Then only strays, members outside the bucket's largest
component, visit the other blocks, so that no task holds more than a block and its visitors, and members of the largest
component are not copied.

Nodes are distinct sets, not documents: copies cost nothing, and rows that share a doc_id cannot be confused.

Defined results: null and blank texts have empty sets and are linked with nothing; so are rows with a null doc_id, which
stay; rows of one doc_id are one document with a row for each text: what one of them is linked with, all are, and each
has its own n_shingles; repeated rows return as often as they occur; texts of any length are whole; an empty table gives
no rows; other columns are carried along by `near_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, identity, mix, release, slices, staged, table, text_buffer, word_hashes, words

WIDTH = 5
PERCENT = 75
BANDS, ROWS = 32, 5
T = BANDS * ROWS
#: Bins of the sketch by which the remaining pairs are chosen.
LONG = 512
#: Members of sets that are compared themselves instead.
SMALL = 1024


BLOCK = 500
#: Pairs of one part of the verification.
PART_PAIRS = 2000


def candidate(bins: int, deviations: float) -> float:
    """Share of equal bins from which a pair is looked at: so many standard deviations below the limit."""
    p = PERCENT / 100
    return p - deviations * (p * (1 - p) / bins) ** 0.5


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row of a buffer, end to end, and the offsets of the rows."""
    data = LOWER[data]
    begin, end, row = words(data, offsets)
    w = word_hashes(data, begin, end)
    n_words = np.bincount(row, minlength=len(offsets) - 1) if len(row) else np.zeros(len(offsets) - 1, np.int64)
    first = np.r_[0, np.cumsum(n_words)]
    value = np.zeros(len(w), np.uint64)
    left = first[row + 1] - np.arange(len(w)) if len(w) else first[:0]
    for k in range(WIDTH):  # a position adds its word only where the row still has one
        follow = w[np.minimum(np.arange(len(w)) + k, max(len(w) - 1, 0))]
        value += np.where(left > k, mix(follow + np.uint64(k + 1)), np.uint64(0)) * np.uint64(2 * k + 0x9E3779B1)
    value = mix(value)
    # A window starts at a word with WIDTH words left, or at the first word of a shorter row.
    is_start = (left >= WIDTH) | (np.arange(len(w)) == first[row]) if len(w) else np.zeros(0, bool)
    value, row = value[is_start], row[is_start]
    order = np.argsort(value)
    small = np.uint16 if len(offsets) <= 65536 else np.int64  # 16-bit keys sort in linear time
    order = order[np.argsort(row[order].astype(small), kind="stable")]
    value, row = value[order], row[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])] if len(value) else np.zeros(0, bool)
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(offsets)))


def sketches(values: np.ndarray, at: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketches, one row of t bins (32 bits each) for every set that isn't empty; others stay full."""
    n = len(at) - 1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, full, np.uint64)
    size = np.diff(at)
    todo = np.flatnonzero(size > 0)
    for i in range(2 * t):
        if not len(todo):
            break
        lengths = size[todo]
        index = np.repeat(at[todo] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        h = mix(values[index] + np.uint64((i + 1) * 0xD1342543DE82EF95 % 2**64))
        who = np.repeat(todo, lengths)
        place = (h >> np.uint64(32)) % np.uint64(t) if i < t else np.uint64(i - t)
        thrown = np.sort(((who * t).astype(np.uint64) + place) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF)))
        target = (thrown >> np.uint64(32)).astype(np.int64)
        head = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])  # the smallest value of each bin comes first
        target, least = target[head], (np.uint64(i) << np.uint64(32)) | (thrown[head] & np.uint64(0xFFFFFFFF))
        out[target] = np.minimum(out[target], least)
        todo = todo[(out.reshape(n, t)[todo] == full).any(1)]
    return mix(out).astype(np.uint32).reshape(n, t)


def _bands(sketch: np.ndarray) -> np.ndarray:
    """One key for each band, distinct between bands."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k] + np.uint64(1))
    return mix(key + np.arange(BANDS, dtype=np.uint64)[None, :])


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, tag (a hash of the text), n_shingles, a 128-bit key of the set and the band keys (none for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            values, at = shingles(*text_buffer(b.column("text")))
            size = np.diff(at)
            bands = _bands(sketches(values, at))[size > 0].reshape(-1)
            ends = np.r_[0, np.cumsum(np.where(size > 0, BANDS, 0))]
            sums = [np.r_[np.uint64(0), np.cumsum(mix(values + np.uint64(salt)))] for salt in (1, 2)]
            keys = [mix(s[at[1:]] - s[at[:-1]] + size.astype(np.uint64)).view(np.int64) for s in sums]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(bands.view(np.int64)))
            yield pa.record_batch([b.column("doc_id"), b.column("tag"), pa.array(size), pa.array(keys[0]), pa.array(keys[1]), lists], ["doc_id", "tag", "n_shingles", "s1", "s2", "bands"])

    return docs.mapInArrow(run, "doc_id long, tag long, n_shingles long, s1 long, s2 long, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """id, size of the set, the sketches in one byte a bin (the long one with the band keys), 16 bits of each member of a
    small set (else null) and the full set of each document (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            values, at = shingles(*text_buffer(b.column("text")))
            sketch = sketches(values, at)
            bands = _bands(sketch).view(np.uint8).reshape(len(sketch), -1)
            short, long = sketch.astype(np.uint8), np.hstack([sketches(values, at, LONG).astype(np.uint8), bands])
            ends = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            sets, cut = [values[i:j].tobytes() for i, j in ends], values.astype(np.uint16)
            small = [cut[i:j].tobytes() if j - i <= SMALL else None for i, j in ends]
            yield pa.record_batch([b.column("id"), pa.array(np.diff(at)), *(pa.array([x.tobytes() for x in y], pa.binary()) for y in (short, long)), pa.array(small, pa.binary()), pa.array(sets, pa.binary())], ["id", "size", "sketch", "long", "small", "members"])

    return docs.select("id", "text").mapInArrow(run, "id long, size long, sketch binary, long binary, small binary, members binary")


def agreement(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity: equal bins, less those that are equal by chance in one byte."""
    return ((one == many).mean(-1) - 1 / 256) / (1 - 1 / 256)


def _forest(ids, sketch, size, label, side, small) -> list[tuple[int, int]]:
    """Prim's maximal spanning forest over the pairs that may be links."""
    n, least = len(ids), candidate(T, 3)
    best, near = agreement(sketch[0], sketch), np.zeros(n, np.int64)
    out, free = [], np.ones(n, bool)
    free[0] = False
    for _ in range(n - 1):
        k = int(np.argmax(np.where(free, best, -1)))
        if best[k] >= least:
            out.append((int(ids[near[k]]), int(ids[k])))
        free[k] = False
        rest = np.flatnonzero(free)
        score = agreement(sketch[k], sketch[rest])
        better = rest[score > best[rest]]
        near[better], best[better] = k, score[score > best[rest]]
    return out


def _across(ids, sketch, size, label, side, small) -> list[tuple[int, int]]:
    """Pairs of a stray and a member of the block with different labels that may be links, each in the first of its
    common bands only.

    side: four times the band, plus two for strays, plus one for those that visit from another block.
    """
    band, stray, visits = int(side[0]) >> 2, side & 2 > 0, side & 1 > 0
    sketch, bands = sketch[:, :LONG], np.ascontiguousarray(sketch[:, LONG:]).view(np.uint64)
    least, index, out = candidate(LONG, 5), np.arange(len(ids)), []
    given = np.array([x is not None for x in small])
    members = [np.frombuffer(x or b"", np.uint16) for x in small]
    for k in np.flatnonzero(stray):
        ok = ~visits & (label != label[k])
        if not visits[k]:
            ok &= ~stray | (index > k)
        ok &= 100 * np.minimum(size, size[k]) >= PERCENT * np.maximum(size, size[k])
        rest = np.flatnonzero(ok)
        rest = rest[(bands[rest] == bands[k]).argmax(1) == band]
        exact = rest[given[rest]] if given[k] else rest[:0]
        rest = rest[~given[rest]] if given[k] else rest
        hit = rest[agreement(sketch[k], sketch[rest]) >= least]
        if len(exact):
            mine = np.zeros(1 << 16, np.int64)
            mine[members[k]] = 1
            both = np.add.reduceat(mine[np.concatenate([members[j] for j in exact])], np.r_[0, np.cumsum(size[exact])[:-1]])
            hit = np.r_[hit, exact[100 * both >= PERCENT * (size[exact] + size[k] - both)]]
        out += [(int(ids[k]), int(ids[j])) for j in hit]
    return out


def _by_bucket(rows: DataFrame, pairs_of) -> DataFrame:
    """Distinct pairs (a < b) that pairs_of makes of each group of rows (key, id, size, label, side, sketch, small)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(part: pa.Table):
            part = part.combine_chunks()
            key, ids, size, label, side = (part.column(c).to_numpy() for c in ("key", "id", "size", "label", "side"))
            sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
            small = part.column("small").to_pylist()
            edges = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            found = []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if j - i > 1:
                    found += pairs_of(ids[i:j], sketch[i:j], size[i:j], label[i:j], side[i:j], small[i:j])
            found = sorted({(min(p), max(p)) for p in found})
            return pa.record_batch([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

        for b in batches:  # a batch's last group may go on in the next one
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut or (held and held[-1].column("key")[-1].as_py() != key[0]):
                done = [*held, b.slice(0, cut)]
                held = [b.slice(cut)]
                yield flush(pa.Table.from_batches(done))
            else:
                held.append(b)
        if held:
            yield flush(pa.Table.from_batches(held))

    rows = rows.select("key", "id", "size", "label", "side", "sketch", "small").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the stored pairs (a, b) whose full sets are similar enough.

    Pairs are dealt in parts by one member, those of a member with many over sixteen; a part holds each set that it needs
    once.
    """
    parts = max(1, pairs.count() // PART_PAIRS)
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(16))), F.lit(parts)))
    wanted = dealt.select("part", F.col("a").alias("id")).unionByName(dealt.select("part", F.col("b").alias("id"))).distinct()
    held = wanted.join(sets.select("id", "members"), "id").select("part", F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "members")
    asked = dealt.select("part", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        now, asking = None, False
        for batch in batches:
            out = []
            for part, kind, a, b, members in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part != now or (asking and kind == 0):
                    known, now, asking = {}, part, False
                if kind == 0:
                    known[a] = np.frombuffer(members, np.uint64)
                    continue
                asking = True
                x, y = known[a], known[b]
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    if len(x) > len(y):
                        x, y = y, x
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        out.append((a, b))
            yield pa.record_batch([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    return held.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id and label, the smallest id of its component, for every end of an edge.

    Labels fall to the least among the neighbours' and then to their own labels' labels, until none falls.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label", F.lit(True).alias("fell")))
    while True:
        now = labels.select("id", "label")
        around = both.join(now.select(F.col("id").alias("b"), "label"), "b").select(F.col("a").alias("id"), "label")
        least = around.unionByName(now).groupBy("id").agg(F.min("label").alias("low"))
        jump = now.select(F.col("id").alias("low"), F.col("label").alias("further"))
        new = least.join(jump, "low").join(now.withColumnRenamed("label", "old"), "id")
        new = staged(new.select("id", F.least("low", "further").alias("label"), (F.least("low", "further") < F.col("old")).alias("fell")))
        release(labels)
        labels = new
        if not new.where("fell").limit(1).count():
            release(both)
            return labels.drop("fell")


def _same_documents(profile: DataFrame) -> DataFrame:
    """a and b: sets that are those of one doc_id."""
    ends = profile.groupBy("doc_id").agg(F.min("s1").alias("a"), F.max("s1").alias("high")).where("a <> high").drop("high")
    return profile.join(ends, "doc_id").where("s1 <> a").select("a", F.col("s1").alias("b")).distinct()


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), identity()[1].alias("tag"), "text")
    profile = staged(profiles(docs))
    named = profile.where("n_shingles > 0 and doc_id is not null")
    nodes = staged(named.groupBy(F.col("s1").alias("id"), "s2").agg(F.min(F.struct("doc_id", "tag")).alias("first"), F.min("bands").alias("bands")))
    buckets = nodes.select("id", "first", F.posexplode("bands").alias("band", "key"))
    # The sizes are stored, so that a hot bucket can be split in the join.
    sizes = staged(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"))
    shared = staged(buckets.join(sizes.hint("merge"), "key").withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")))
    release(sizes)
    wanted = shared.select("id", "first.doc_id", "first.tag").distinct()
    sets = staged(full_sets(docs.join(wanted, ["doc_id", "tag"]).dropDuplicates(["id"])))
    shared = shared.select("id", "band", "key", "blocks", "block")
    in_block = shared.join(sets.select("id", "size", "sketch"), "id").select(F.xxhash64("key", "block").alias("key"), "id", "size", F.lit(0).alias("label"), F.lit(0).alias("side"), "sketch", F.lit(None).cast("binary").alias("small"))
    first = staged(_by_bucket(in_block, _forest))
    links = staged(verified(first, sets).unionByName(_same_documents(named)))
    labels = components(links)
    rest = staged(_rest(shared, labels, sets).join(first, ["a", "b"], "left_anti"))
    more = staged(links.unionByName(verified(rest, sets)))
    release(first, links, sets, rest)
    labels = components(more)
    release(more)
    label = nodes.select("id", "s2", "first").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = label.groupBy("label").agg(F.min("first.doc_id").alias("component"))
    names = label.join(least, "label").select(F.col("id").alias("s1"), "s2", "component")
    out = profile.drop("bands", "tag").join(names, ["s1", "s2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _rest(shared: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of buckets whose members have different labels."""
    at = shared.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    main = at.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    at = at.join(main, "key").withColumn("stray", F.col("label") != F.col("main"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block"))
    visits = at.where("stray and blocks > 1").withColumn("block", F.explode(others)).withColumn("visits", F.lit(1))
    at = at.withColumn("visits", F.lit(0)).unionByName(visits)
    at = at.select(F.xxhash64("key", "block").alias("key"), "id", "label", (F.col("band") * 4 + F.col("stray").cast("int") * 2 + F.col("visits")).alias("side"))
    return _by_bucket(at.join(sets.select("id", "size", F.col("long").alias("sketch"), "small"), "id"), _across)


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs without all but the first of each component of near duplicates."""
    gone = near_components(docs).where("not kept").select(F.col("doc_id").alias("of_doc")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["of_doc"], "left_anti")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
