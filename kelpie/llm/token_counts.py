"""Token counts by a compiled finite-state transducer.

A byte-level BPE tokenizer is compiled, lazily and exactly, into a deterministic transducer whose transitions carry the
change of the emitted-token count:

* Pre-tokenisation is a one-symbol-lookahead automaton over character classes. Where a piece starts depends on the
  neighbouring classes alone, so all starts of a buffer are found at once; a start resets the byte transducer.
* Within a piece, the last token of the encoding of every prefix is determined by the last tokens of shorter prefixes
  (a token may follow another one if encoding their concatenation gives the two back). A state holds, for each suffix
  of the prefix read that some token continues, the last token before it and its count relative to the present one.
  States and transitions are made when first met and kept, up to `MAX_STATES`; beyond, the table starts anew, which
  changes no result.

A buffer of whole texts is cut into chunks at fixed places, whatever they split. The map of a chunk takes a state to a
state and a count: its bytes up to the first reset depend on the state that comes in, the rest does not, so the map of a
chunk with a reset is constant in the state. Chunks without one are mapped at the states that can enter them: the state
that the chunk before leaves of a piece that starts with it, and the known one at the start of a run of such chunks; equal
chunks share a map. A parallel prefix scan composes the maps of a run in doubling steps. Where it meets a state outside a
map, the map is extended by it and the scan repeated, so counts are exact; a text that never forgets its start and never
repeats takes a round for each chunk at worst.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows each return; an empty table gives no
rows; other columns are ignored. The strings of special tokens inside texts count as one token, as the library does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_buffer

CHUNK = 2048
MAX_STATES = 300_000
TOKEN_LIMIT = 512


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """The lazily determinised transducer of one vocabulary, over pieces of bytes."""

    def __init__(self, merges: list[tuple[bytes, bytes]], singles: list[bytes]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.tokens = {t: t for t in [*singles, *(a + b for a, b in merges)]}
        self.prefixes = {t[:n] for t in self.tokens for n in range(1, len(t) + 1)}
        self.follows = {}
        self.reset()

    def reset(self) -> None:
        self.states = {(b"", ((0, b"", 0),)): 0}
        self.keys = [(b"", ((0, b"", 0),))]
        self.edges = 0
        self._table(1 << 18)

    def _table(self, size: int) -> None:
        """An open-addressing table of transitions: state * 256 + byte to target * 256 + emission + 128."""
        self.mask, self.shift = size - 1, np.uint64(64 - size.bit_length() + 1)
        self.at, self.edge = np.full(size, -1, np.int64), np.zeros(size, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        at, edge, mask = self.at, self.edge, self.mask
        for key, value, slot in zip(keys.tolist(), values.tolist(), self._slot(keys).tolist(), strict=True):
            while at[slot] >= 0:
                slot = (slot + 1) & mask
            at[slot], edge[slot] = key, value

    def _add(self, keys: list[int], values: list[int]) -> None:
        self.edges += len(keys)
        if self.edges * 3 > self.mask:
            old, edges = self.at, self.edge
            self._table((self.mask + 1) * 4)
            self._put(old[old >= 0], edges[old >= 0])
        self._put(np.array(keys, np.int64), np.array(values, np.int64))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The edge of each key, -1 if it isn't made yet."""
        slot = self._slot(keys)
        found = self.at[slot]
        out = self.edge[slot]
        wrong = np.flatnonzero(found != keys)
        while len(wrong):
            empty = found[wrong] < 0
            out[wrong[empty]] = -1
            wrong = wrong[~empty]
            slot[wrong] = (slot[wrong] + 1) & self.mask
            found[wrong] = self.at[slot[wrong]]
            out[wrong] = self.edge[slot[wrong]]
            wrong = wrong[found[wrong] != keys[wrong]]
        return out

    def encode(self, piece: bytes) -> list[bytes]:
        """The merges applied in order of rank, as the tokenizer defines them."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def can_follow(self, last: bytes, token: bytes) -> bool:
        key = (last, token)
        if key not in self.follows:
            if len(self.follows) > 500_000:
                self.follows.clear()
            self.follows[key] = self.encode(last + token) == ([last, token] if last else [token])
        return self.follows[key]

    def step(self, state: int, byte: int) -> int:
        """The edge from a state by a byte, its target made if it is new."""
        suffix, entries = self.keys[state]
        text = suffix + bytes([byte])
        kept, found = [], None
        for back, last, count in entries:
            grown = text[len(text) - back - 1 :]
            if grown in self.prefixes:
                kept.append((back + 1, last, count))
                if found is None and grown in self.tokens and self.can_follow(last, grown):
                    found = (self.tokens[grown], count + 1)
        token, emitted = found
        kept.append((0, token, emitted))
        longest = kept[0][0]
        key = (text[len(text) - longest :] if longest else b"", tuple((b, t, c - emitted) for b, t, c in kept))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.keys)
            self.keys.append(key)
        return to * 256 + emitted + 128

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and emissions of many lanes, each reading one byte."""
        keys = states * 256 + symbols
        edges = self._find(keys)
        if len(edges) and edges.min() < 0:
            new = np.unique(keys[edges < 0]).tolist()
            self._add(new, [self.step(k >> 8, k & 255) for k in new])
            edges = self._find(keys)
        return edges >> 8, (edges & 255) - 128

    def run(self, states: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after and emissions of whole lanes (one a column), each from its own state."""
        counts = np.zeros(len(states), np.int64)
        for row in lanes:
            states, emitted = self.advance(states, row.astype(np.int64))
            counts += emitted
        return states, counts

    def through(self, lanes: np.ndarray, heads: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after and counts of chunks without a reset, in runs of neighbours.

        lanes: a chunk a column; heads: where a run starts; entry: the state that enters each run, at its start.
        """
        n = len(heads)
        _, sample, kind = np.unique(np.ascontiguousarray(lanes.T).view(f"V{len(lanes)}").ravel(), return_index=True, return_inverse=True)
        maps = ChunkMaps()

        def extend(kinds: np.ndarray, states: np.ndarray) -> None:
            pairs = np.unique(kinds << 32 | states)
            pairs = pairs[maps.find(pairs >> 32, pairs & 0xFFFFFFFF) < 0]
            if len(pairs):
                maps.add(pairs, *self.run(pairs & 0xFFFFFFFF, lanes[:, sample[pairs >> 32]]))

        first = np.flatnonzero(heads)
        inner = np.flatnonzero(~heads)
        extend(np.append(kind[first], kind[inner - 1]), np.append(entry, np.zeros(len(inner), np.int64)))
        # What a chunk does to the state of a piece that starts with it is the guess of what enters the next one.
        extend(kind[inner], maps.to[maps.find(kind[inner - 1], np.zeros(len(inner), np.int64))])
        run_of = np.cumsum(heads) - 1
        while True:
            after = maps.scan(kind, heads, entry[run_of])
            state = np.where(heads, entry[run_of], np.append(0, after[:-1]))
            outside = np.flatnonzero((after < 0) & (state >= 0))
            if not len(outside):
                return after, maps.count[maps.find(kind, state)] if n else after
            extend(kind[outside], state[outside])

    def emissions(self, data: np.ndarray, resets: np.ndarray) -> np.ndarray:
        """Change of the token count at each byte; resets marks the bytes at which a piece starts (the first does).

        A chunk without a reset has its whole change at its first byte.
        """
        if len(self.keys) > MAX_STATES:
            self.reset()
        n = -(-len(data) // CHUNK)
        lanes, starts = np.zeros(n * CHUNK, np.uint8), np.zeros(n * CHUNK, bool)
        lanes[: len(data)], starts[: len(data)] = data, resets
        starts[len(data) :] = True  # padding belongs to no piece
        lanes, starts = (np.ascontiguousarray(x.reshape(n, CHUNK).T) for x in (lanes, starts))
        out = np.zeros((CHUNK, n), np.int16)
        known, first = starts.any(0), starts.argmax(0)
        tail = np.zeros(n, np.int64)
        # The part of every chunk from its first reset on does not depend on what comes before.
        width = np.where(known, first, CHUNK)
        for i in range(CHUNK):
            lane = slice(None) if i >= width.max() else np.flatnonzero(width <= i)
            tail[lane], out[i, lane] = self.advance(np.where(starts[i, lane], 0, tail[lane]), lanes[i, lane].astype(np.int64))
        # Maps of chunks with a reset are constant in the state, so the scan runs between them.
        whole = np.flatnonzero(~known)
        if len(whole):
            heads = known[whole - 1]
            tail[whole], out[0, whole] = self.through(lanes[:, whole], heads, tail[whole[heads] - 1])
        # What they count depends on the state that the scan hands them, up to their first reset.
        part = np.flatnonzero(known & (width > 0))
        state = tail[part - 1].copy()
        for i in range(int(width[part].max(initial=0))):
            act = np.flatnonzero(width[part] > i)
            state[act], out[i, part[act]] = self.advance(state[act], lanes[i, part[act]].astype(np.int64))
        return out.T.reshape(-1)[: len(data)]


class ChunkMaps:
    """State maps of kinds of chunks, each over the states that it was asked for: (kind, state) to (state, count)."""

    def __init__(self):
        self.pairs, self.to, self.count = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, pairs: np.ndarray, to: np.ndarray, count: np.ndarray) -> None:
        pairs = np.append(self.pairs, pairs)
        order = np.argsort(pairs)
        self.pairs, self.to, self.count = pairs[order], np.append(self.to, to)[order], np.append(self.count, count)[order]

    def find(self, kinds: np.ndarray, states: np.ndarray) -> np.ndarray:
        """The place of each (kind, state), -1 outside the map's states."""
        return lookup(self.pairs, kinds, states)

    def scan(self, kind: np.ndarray, heads: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """The state after each chunk, -1 where a chunk before it or itself isn't mapped at the state that comes in.

        Maps of spans are composed in doubling steps, all chunks side by side, each span from its run's start at last.
        """
        n = len(kind)
        kinds = self.pairs >> 32
        # A row for each state in the map of each chunk: chunk << 32 | state in, state out.
        size = np.searchsorted(kinds, kind, "right") - (low := np.searchsorted(kinds, kind, "left"))
        chunk = np.repeat(np.arange(n), size)
        at = np.arange(len(chunk)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        keys, to = chunk << 32 | self.pairs[at] & 0xFFFFFFFF, self.to[at]
        start = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
        span = np.ones(n, np.int64)  # chunks in the span that ends with each chunk
        while len(more := np.flatnonzero(np.arange(n) - span >= start)):
            before = more - span[more]
            # The earlier span's rows, handed on through the later span's map.
            low, high = np.searchsorted(keys, before << 32), np.searchsorted(keys, (before + 1) << 32)
            size = high - low
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
            owner = np.repeat(more, size)
            found = lookup(keys, owner, np.maximum(to[at], 0))
            grown = np.where((to[at] >= 0) & (found >= 0), to[found], -1)
            stay = ~np.isin(keys >> 32, more)
            keys, to = np.append(keys[stay], owner << 32 | keys[at] & 0xFFFFFFFF), np.append(to[stay], grown)
            order = np.argsort(keys)
            keys, to = keys[order], to[order]
            span[more] += span[before]
        found = lookup(keys, np.arange(n), entry)
        return np.where(found >= 0, to[found], -1)


def lookup(keys: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Places of high << 32 | low in sorted keys, -1 if absent."""
    wanted = high << 32 | low
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point: 0 other, 1 letter, 2 number, 3 white space but the space, 4 the space, 5 apostrophe."""
    import regex

    every = [chr(i) if not 0xD800 <= i < 0xE000 else "\0" for i in range(0x110000)]
    whole = "".join(every)
    out = np.zeros(0x110000, np.uint8)
    for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, whole):
            out[m.start() : m.end()] = k
    out[32], out[39] = 4, 5
    return out


def piece_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each character. codes: code points; first: where a text (or a forced cut) begins."""
    n = len(codes)
    if not n:
        return np.zeros(0, bool)
    kind = char_classes()[codes]
    group = np.where(kind == 4, 3, np.where(kind == 5, 0, kind))
    before, after = np.empty(n, np.int8), np.empty(n, np.int8)
    before[0], before[1:] = -1, group[:-1]
    after[-1], after[:-1] = -1, group[1:]
    before[first] = -1
    after[:-1][first[1:]] = -1
    space = group == 3
    spaced = np.zeros(n, bool)
    spaced[1:] = kind[:-1] == 4
    spaced &= ~first
    start = np.where(space, (before != 3) | ((after != 3) & (after != -1)), (before != group) & ~spaced)
    start |= first
    quote = np.flatnonzero((kind == 5) & start)
    if len(quote):  # contractions: 's 't 'm 'd 're 've 'll
        edges = np.flatnonzero(first)
        stop = np.append(edges, n)[np.searchsorted(edges, quote, "right")]
        one = np.where(quote + 1 < stop, codes[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(quote + 2 < stop, codes[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for at, size, limit in ((quote[short], 2, stop[short]), (quote[long], 3, stop[long])):
            start[at + 1] = False
            inside = at + size < limit
            start[(at + size)[inside]] = True
    return start


class Counter:
    """Counts the tokens of texts as the given `tokenizers` file does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.transducer = Transducer([(raw(a), raw(b)) for a, b in merges], [bytes([b]) for b in range(256)])

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row of a UTF-8 buffer."""
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        cut = first[:-1].copy()
        extra, drop = np.zeros(len(offsets) - 1, np.int64), None
        blob = data.tobytes()
        for name in self.special:
            mark, here = name.encode(), 0
            while (here := blob.find(mark, here)) >= 0:
                row = int(np.searchsorted(offsets, here, "right")) - 1
                if here + len(mark) > offsets[row + 1]:
                    here += 1
                    continue
                drop = np.zeros(len(data), bool) if drop is None else drop
                drop[here : here + len(mark)] = True
                cut[here] = True
                if here + len(mark) < len(data):
                    cut[here + len(mark)] = True
                extra[row] += 1
                here += len(mark)
        start = np.zeros(len(data), bool)
        start[at] = piece_starts(codes, cut[at])
        if drop is not None:  # special strings leave the buffer; what follows them starts a piece
            data, start = data[~drop], start[~drop]
            offsets = np.concatenate([[0], np.cumsum(~drop)])[offsets]
        if not len(data):
            return extra
        sums = np.concatenate([[0], np.cumsum(self.transducer.emissions(data, start), dtype=np.int64)])
        return extra + np.diff(sums[offsets])


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One compiled counter for each vocabulary and worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text. vocabulary: a byte-level BPE file of `tokenizers`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in slices(batches, "text", 8 << 20):
            data, offsets = text_buffer(b.column("text"))
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(c.counts(data, offsets))], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
