"""Hierarchical Pitman-Yor language model over words, with Chinese-restaurant seating sampled by Gibbs.

Words are those of the corpus, A-Z in lower case, and each text ends with one end token. Every preceding word (and the
start of a text) is a context restaurant whose customers are the training tokens that follow it, as many as the corpus
has. All contexts share one parent, the restaurant of words; its customers are the tables of the contexts, and its base
is uniform over the known words and one event for all words never seen.

Seating. A sweep takes every customer of every dish from its table and seats it anew: at a table with the weight
size - discount, at a new one with (strength + discount * tables of the restaurant) * probability of the dish in the
parent. A context's tables count as they are when a customer chooses; its dishes move a customer each at a time. After
each sweep of the contexts their tables are the parent's customers, opened and closed ones included, the parent is seated
with them, and its probabilities hold for the next sweep. The first sweep has a parent with a customer for each different
pair. In dishes of more than SINGLY customers each leaves with one chance in CROWD, CROWD times a sweep, and those who
left choose each for itself among the tables that stayed. Up to THRONG customers such dishes do so side by side, those of
one restaurant too, which counts the tables that closed before the choice and those that opened after it; larger dishes
move one after another. The parent counts its tables after each of its sweeps, and is seated from the start after each
sweep of the contexts. Predictive probabilities are averaged over the sweeps after burn-in and give perplexity. Discounts
come from the counts of counts of each level. Draws are hashes of dish, sweep and customer (a generator of dish and sweep
above THRONG): any executor draws the same ones, whatever the partitioning.

`score_documents` without `joint` is the plainer sampler that op2 had: GROUPS groups a dish, tables counted after each
sweep, one parent for all sweeps of the contexts.

Data flow. Documents are dealt into parts. A part asks the shards of its contexts about its distinct pairs of words, once
each, in byte strings; a shard merges what all parts ask, seats its contexts and answers in the order of the question.
Most pairs occur once: they have one table whatever the draws, so shards seat repeated pairs only. Shards and blocks of
the parent's words store their seats between sweeps, so that no sweep is made twice. Nothing that grows
with the vocabulary is broadcast or sent to the driver. The distinct followers of one context have to fit into one task,
their occurrences do not.

Defined results: a null text is empty and scores its end token; rows with a null doc_id are training rows if the caller's
column says nothing of them; repeated rows count and return as often as they occur; texts of any length are whole; an
empty table gives no rows; without training rows everything is the one event never seen, of probability 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, mix, release, slices, staged, table, text_buffer, training_fold, word_hashes, words

STRENGTH = 1.0
BURN, KEEP = 2, 2
#: Of the parent, when it has its first customers and when it has the contexts' tables.
FIRST_SWEEPS, LAST_SWEEPS = (1, 1), (1, 2)
#: Groups in which the customers of a dish move, unless they move singly.
GROUPS = 32
#: Dishes of more customers than this are crowds, where one in CROWD moves at a time.
SINGLY = 1024
CROWD = 64
#: Crowds up to this size move side by side, customer by customer; larger ones one after another, by counts of their tables.
THRONG = 1 << 15
#: Places of a dish that are summed up, where dishes have many tables.
LANE = 32
#: Text bytes of one part of documents, and of one shard of contexts.
PART_BYTES = SHARD_BYTES = 16 << 20
END = np.uint64(0x5EED0FE4D0C5)
START = np.uint64(0x5EED0FE4D0C7)
BLOCK = 1 << 20


# ---- seating


def uniform(seed: np.ndarray, sweep: int, customer: int) -> np.ndarray:
    h = mix(seed + np.uint64(((sweep + 1) * 0x9E3779B97F4A7C15 + (customer + 1) * 0xD1342543DE82EF95) % 2**64))
    return (h >> np.uint64(11)).astype(float) / 2**53


def _uniforms(seed: np.ndarray, sweep: int, series: int, customer: np.ndarray) -> np.ndarray:
    """As uniform, for several series of customers."""
    key = customer.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    return uniform(seed + key, sweep, series << 32)


class Seating:
    """Tables of many dishes of n >= 1 customers each, moved by Gibbs sweeps.

    singly: each customer moves on its own, and not one of at most GROUPS groups. context: the restaurants of the dishes,
    if what one dish does changes the weights of others; the customers j of a restaurant's dishes then move together.
    """

    def __init__(self, n: np.ndarray, seed: np.ndarray, discount: float, singly: bool = False, context: np.ndarray | None = None):
        self.n, self.seed, self.discount, self.done = n, seed, discount, 0
        self.tables = np.ones(len(n), np.int64)  # a single customer always has one
        most = SINGLY if singly else GROUPS
        groups = np.minimum(n, most)
        self.crowds = np.flatnonzero(n > most) if singly else np.zeros(0, np.int64)
        if context is not None:
            self.crowds = self.crowds[np.lexsort((seed[self.crowds], context[self.crowds]))]
        self.crowd_sizes = [np.zeros(0, np.int64) for _ in self.crowds]
        groups[self.crowds] = 0
        self.parts = []
        width = 2
        while width // 2 < most:
            own = np.flatnonzero((groups > width // 2) & (groups <= width))
            at = np.arange(len(own))
            if context is not None:  # a restaurant is never cut, so that blocks do not matter
                own = own[np.argsort(context[own], kind="stable")]
                at = np.searchsorted(context[own], context[own], "left")
            block = at // max(1, (1 << 20) // max(width, 32))
            for at in np.split(own, np.flatnonzero(np.diff(block)) + 1):
                if len(at):
                    at = at[np.argsort(-groups[at], kind="stable")]
                    self.parts.append((at, n[at], groups[at], np.zeros((len(at), width)), np.zeros((len(at), width), np.int16)))
            width *= 2

    def sweep(self, opening: np.ndarray | Callable, moved: Callable | None = None) -> np.ndarray:
        """Tables of each dish after its customers moved.

        opening: the weight of a new table, of all dishes, or as it is for some at that time; moved: is told of the
        dishes whose customers moved and of how many tables they gained.
        """
        weight_of = opening if callable(opening) else opening.__getitem__
        told = moved or (lambda at, gained: None)
        for at, n, groups, sizes, seats in self.parts:
            self._move_rows(at, n, groups, sizes, seats, weight_of, moved)
            self.tables[at] = (sizes > 0).sum(1)
        small = self.n[self.crowds] <= THRONG
        if small.any():
            self._move_throng(np.flatnonzero(small), weight_of, told)
        for i in np.flatnonzero(~small).tolist():
            one = self.crowds[i : i + 1]
            self.crowd_sizes[i] = self._move_crowd(self.crowd_sizes[i], int(self.n[one[0]]), int(self.seed[one[0]]), lambda: float(weight_of(one)[0]), lambda k: told(one, np.array([k])))  # noqa: B023
        self.tables[self.crowds] = [len(x) for x in self.crowd_sizes]
        self.done += 1
        return self.tables

    def _move_rows(self, at: np.ndarray, n: np.ndarray, groups: np.ndarray, sizes: np.ndarray, seats: np.ndarray, weight_of: Callable, moved: Callable | None) -> None:
        """The customers j of all dishes, one j after another. A dish has a row of places; a new table takes the first empty one."""
        (rows, width), d, seed = sizes.shape, self.discount, self.seed[at]
        base, most = np.arange(rows) * width, int(np.flatnonzero(np.r_[True, (sizes > 0).any(0)])[-1])
        pull = np.where(sizes > 0, sizes - d, 0.0)  # kept up to date, as is the first empty place
        free = _first_empty(sizes)
        size_of, pull_of = sizes.reshape(-1), pull.reshape(-1)
        single, lanes = bool((n == groups).all()), None
        for j, m in enumerate(np.searchsorted(-groups, -np.arange(width), "left").tolist()):  # m dishes with a customer j
            if not m:
                break
            weight = 1 if single else n[:m] // groups[:m] + (j < n[:m] % groups[:m])
            if lanes is None and most >= 2 * LANE:
                lanes = _Lanes(sizes, d)
            start, empty, seat = base[:m], free[:m], seats[:m, j]
            if self.done:
                place = start + seat
                size = size_of[place] - weight
                closed = size == 0
                size_of[place], pull_of[place] = size, np.where(closed, 0.0, size - d)
                np.minimum(empty, seat, out=empty, where=closed)
                if lanes:
                    lanes.add(place, -weight, -closed.astype(np.int64))
            new = weight_of(at[:m])
            spot = start + empty  # one place is empty, now that one is up
            pull_of[spot] = new
            draw, wide = uniform(seed[:m], self.done, j), min(most + 1, width)  # places behind are empty
            if lanes:
                chosen = lanes.choose(pull, start, spot, new, draw, wide)
            else:
                sums = pull[:m, :wide].cumsum(1)
                chosen = np.minimum((sums <= (draw * sums[:, -1])[:, None]).sum(1), wide - 1)
            pull_of[spot] = 0.0
            seat[:] = chosen
            place = start + chosen
            size = size_of[place]
            opened = size == 0
            size = size + weight
            size_of[place], pull_of[place] = size, size - d
            if lanes:
                lanes.add(place, weight, opened.astype(np.int64))
            most = max(most, int(chosen.max()) + 1)
            some = np.flatnonzero(opened)
            if len(some):
                free[some] = _first_empty(sizes[some, : min(most + 1, width)])
            if moved:
                moved(at[:m], opened.astype(np.int64) - closed if self.done else opened.astype(np.int64))

    def _move_throng(self, which: np.ndarray, weight_of: Callable, moved: Callable) -> None:
        """As _move_crowd, for many crowds side by side: everyone draws for itself whether it leaves and where it sits."""
        at, number = self.crowds[which], np.arange(len(which))
        n, seed, count = self.n[at], self.seed[at], lambda of: np.bincount(of, minlength=len(which))
        sizes = np.concatenate([self.crowd_sizes[i] for i in which.tolist()])
        of = np.repeat(number, [len(self.crowd_sizes[i]) for i in which.tolist()])
        left, rounds = np.zeros(len(n), np.int64) if self.done else n.copy(), 0
        tries = (n / CROWD + 8 * np.sqrt(n / CROWD) + 16).astype(np.int64)
        trier, attempt = np.repeat(number, tries), _within(tries)
        grain = 1 << 24  # weights of tables are whole numbers of grains, whose sums are the same wherever a dish is
        while rounds < CROWD if self.done else left.any():
            if self.done:  # from one who leaves to the next
                gap = 1 + (np.log1p(-_uniforms(seed[trier], self.done, 2 * rounds, attempt)) / np.log1p(-1 / CROWD)).astype(np.int64)
                to = gap.cumsum()
                to -= np.r_[0, to[tries.cumsum()[:-1] - 1]][trier]
                leaves = to <= n[trier]
                some = count(trier[leaves])
                ends = sizes.cumsum()
                sizes = sizes - np.bincount(np.searchsorted(ends, (n.cumsum() - n)[trier[leaves]] + to[leaves], "left"), minlength=len(sizes))
                stay = sizes > 0
                moved(at, -count(of[~stay]))
                sizes, of = sizes[stay], of[stay]
            else:  # those who are not seated yet come in growing numbers
                some = np.minimum(left, np.maximum(1, (n - left) // 8))
                left -= some
            tables, new = count(of), weight_of(at)
            rest = n - left - some - self.discount * tables
            who = np.repeat(number, some)
            x = _uniforms(seed[who], self.done, 2 * rounds + 1, _within(some)) * (rest + new)[who] - new[who]
            opens = (x < 0) | (tables[who] == 0)
            joins, x = who[~opens], x[~opens]
            ends = np.r_[0, (sizes * grain - round(self.discount * grain)).cumsum()]
            edge = ends[np.r_[0, tables.cumsum()]]
            whole = np.diff(edge)
            target = edge[joins] + np.minimum((x / rest[joins] * whole[joins]).astype(np.int64), whole[joins] - 1)
            sizes = sizes + np.bincount(np.searchsorted(ends[1:], target, "right"), minlength=len(sizes))
            own = who[opens]
            of = np.r_[of, own]
            order = np.argsort(of, kind="stable")
            sizes, of = np.r_[sizes, np.ones(len(own), np.int64)][order], of[order]
            moved(at, count(own))
            rounds += 1
        for i, x in zip(which.tolist(), np.split(sizes, count(of).cumsum()[:-1]), strict=True):
            self.crowd_sizes[i] = x

    def _move_crowd(self, sizes: np.ndarray, n: int, seed: int, opening: Callable, moved: Callable) -> np.ndarray:
        """Each of CROWD times one in CROWD leaves, and everyone who left chooses a table for itself."""
        draw = np.random.Generator(np.random.Philox(key=np.array([seed, self.done], np.uint64)))
        left = 0 if self.done else n  # those who are not seated yet come in growing numbers
        rounds = 0
        while left or (self.done and rounds < CROWD):
            before, rounds = len(sizes), rounds + 1
            if self.done:
                leave = draw.binomial(sizes, 1 / CROWD)
                some, sizes = int(leave.sum()), sizes - leave
                sizes = sizes[sizes > 0]
            else:
                some = min(left, max(1, (n - left) // 8))
                left -= some
            pull = np.r_[sizes - self.discount, opening()]
            to = draw.multinomial(some, pull / pull.sum())
            sizes = np.r_[sizes + to[:-1], np.ones(to[-1], np.int64)]
            moved(len(sizes) - before)
        return sizes

    def dump(self) -> dict[str, bytes]:
        """What a later sweep goes on from."""
        lengths = np.array([self.done, *map(len, self.crowd_sizes)], np.int64)
        return {"seats": b"".join(x[-1].tobytes() for x in self.parts), "crowds": _planes(np.concatenate([lengths, *self.crowd_sizes]))}

    def load(self, state: dict[str, bytes]) -> None:
        i, crowds = 0, _unplanes(state["crowds"])
        self.done, k = int(crowds[0]), len(self.crowds)
        ends = (k + 1 + np.cumsum(crowds[1 : k + 1])).tolist()
        self.crowd_sizes = [crowds[a:b] for a, b in zip([k + 1, *ends], ends, strict=False)]
        self.tables[self.crowds] = crowds[1 : k + 1]
        for at, n, groups, sizes, seats in self.parts:
            seats[:] = np.frombuffer(state["seats"], np.int16, seats.size, i).reshape(seats.shape)
            i += seats.nbytes
            j = np.arange(seats.shape[1])
            row, j = np.nonzero(j < groups[:, None])
            weight = n[row] // groups[row] + (j < n[row] % groups[row])
            sizes[:] = np.bincount(row * seats.shape[1] + seats[row, j], weight, sizes.size).reshape(sizes.shape)
            self.tables[at] = (sizes > 0).sum(1)


class _Lanes:
    """Sums of LANE places each, so that a choice looks at the sums of a dish and then at the places of one lane."""

    def __init__(self, sizes: np.ndarray, discount: float):
        shape = len(sizes), -1, LANE
        self.discount, self.count = discount, sizes.shape[1] // LANE
        self.customers, self.tables = sizes.reshape(shape).sum(2).reshape(-1), (sizes > 0).reshape(shape).sum(2).reshape(-1)
        self.sums = self.customers - discount * self.tables

    def add(self, place: np.ndarray, customers: np.ndarray | int, tables: np.ndarray | int) -> None:
        lane = place // LANE
        self.customers[lane] += customers
        self.tables[lane] += tables
        self.sums[lane] = self.customers[lane] - self.discount * self.tables[lane]

    def choose(self, pull: np.ndarray, start: np.ndarray, spot: np.ndarray, new: np.ndarray, draw: np.ndarray, wide: int) -> np.ndarray:
        """spot: the place of a new table in each row, of weight new, which `pull` has already."""
        every, lanes = np.arange(len(start)), -(-wide // LANE)
        self.sums[spot // LANE] += new
        sums = self.sums.reshape(-1, self.count)[: len(start), :lanes].cumsum(1)
        self.add(spot, 0, 0)
        x = draw * sums[:, -1]
        lane = np.minimum((sums <= x[:, None]).sum(1), lanes - 1)
        x -= np.where(lane > 0, sums[every, lane - 1], 0.0)
        inside = pull.reshape(-1, LANE)[start // LANE + lane].cumsum(1)
        return lane * LANE + np.minimum((inside <= x[:, None]).sum(1), LANE - 1)


def _first_empty(sizes: np.ndarray) -> np.ndarray:
    """Of each row; the width if there is none."""
    empty = sizes == 0
    first = empty.argmax(1)
    return np.where(empty[np.arange(len(first)), first], first, sizes.shape[1])


def _within(count: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each."""
    return np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)


def discount_of(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(1.0, ones + 2 * twos), 0.05, 0.95))


def seat_contexts(context: np.ndarray, n: np.ndarray, seed: np.ndarray, parent: np.ndarray, singles: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of each dish in the last sweep, and sums over the kept sweeps of the tables of each dish and each context.

    Dishes are the repeated pairs (context, n, the word's probability in the parent); singles: the others of a context.
    """
    seating = Seating(n, seed, discount)
    total = singles + np.bincount(context, minlength=len(singles))
    tables, dish_sum, context_sum = np.ones(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(singles), np.int64)
    for s in range(BURN + KEEP):
        tables = seating.sweep((STRENGTH + discount * total[context]) * parent)
        total = singles + np.bincount(context, tables, len(singles)).astype(np.int64)
        if s >= BURN:
            dish_sum += tables
            context_sum += total
    return tables, dish_sum, context_sum


def move_contexts(context: np.ndarray, n: np.ndarray, seed: np.ndarray, parent: np.ndarray, singles: np.ndarray, discount: float, state: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray, dict[str, bytes]]:
    """One sweep of single customers, each of which meets the tables that its restaurant has at that time.

    Tables of each dish and each context, and what the next sweep goes on from; arguments as in seat_contexts, `state`
    is what the sweep before left, if there was one.
    """
    seating = Seating(n, seed, discount, True, context)
    total = singles.copy()
    if "seats" in state:
        seating.load(state)
        total += np.bincount(context, seating.tables, len(singles)).astype(np.int64)

    def moved(at: np.ndarray, gained: np.ndarray) -> None:
        some = np.flatnonzero(gained)
        np.add.at(total, context[at[some]], gained[some])

    tables = seating.sweep(lambda at: (STRENGTH + discount * total[context[at]]) * parent[at], moved)
    return tables, total, seating.dump()


class Parent:
    """The restaurant of words: its totals, and the tables that each sweep left in all of it."""

    def __init__(self, customers: int, dishes: int, ones: int, twos: int, singly: bool = False):
        self.customers, self.dishes, self.discount, self.singly = customers, dishes, discount_of(ones, twos), singly
        self.totals = [dishes]

    def opening(self, sweep: int) -> float:
        return (STRENGTH + self.discount * self.totals[sweep]) / (self.dishes + 1)

    def sweep(self, word: np.ndarray, c: np.ndarray, state: dict[str, bytes]) -> tuple[np.ndarray, dict[str, bytes]]:
        """Tables of each word after the sweep that is next, and what the one after it goes on from."""
        seating = Seating(c, word, self.discount, self.singly)
        if state:
            seating.load(state)
        tables = seating.sweep(np.full(len(c), self.opening(len(self.totals) - 1)))
        return tables, seating.dump()

    def probability(self, c: np.ndarray, tables: np.ndarray, keep: int) -> np.ndarray:
        """Averaged over the last `keep` sweeps, which had so many tables of each word in all."""
        return (c - self.discount * tables / keep) / (STRENGTH + self.customers) + self.unseen(keep)

    def unseen(self, keep: int) -> float:
        return sum(self.opening(s) for s in range(len(self.totals) - keep, len(self.totals))) / keep / (STRENGTH + self.customers)


def _many_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and their counts, BLOCK of them or somewhat more at a time: large dishes are moved side by side."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for b in batches:
        held.append((b.column("word").to_numpy().view(np.uint64), b.column("c").to_numpy()))
        size += b.num_rows + int(np.minimum(held[-1][1], SINGLY).sum()) // 16  # their seats are kept
        if size >= BLOCK:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


SEATED = {"word": pa.binary(), "c": pa.binary(), "kept": pa.binary(), "seats": pa.binary(), "crowds": pa.binary(), "total": pa.int64()}
SEATS = "word binary, c binary, kept binary, seats binary, crowds binary, total long"


def _seated(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, bytes]]]:
    """Blocks of words with their counts, the sums of their tables in the kept sweeps, and their seats."""
    for b in batches:
        for i in range(b.num_rows):
            word, c, kept, seats, crowds = (b.column(x)[i].as_py() for x in ("word", "c", "kept", "seats", "crowds"))
            yield np.frombuffer(word, np.uint64), _unplanes(c), _unplanes(kept), {"seats": seats, "crowds": crowds}


def seat_words(counts: DataFrame, burn: int, keep: int, shards: int, singly: bool = False) -> tuple[Parent, DataFrame]:
    """The parent of stored word counts (word, c >= 1), and shard, word, p, to be released. A sweep sends one number to the driver."""
    found = counts.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    parent = Parent(*(int(x or 0) for x in found), singly)
    seated = None
    for s in range(burn + keep):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = _seated(batches) if s else ((w, c, np.zeros(len(w), np.int64), {}) for w, c in _many_words(batches))  # noqa: B023
            for word, c, kept, state in blocks:
                tables, left = parent.sweep(word, c, state)
                if s >= burn:  # noqa: B023
                    kept = kept + tables
                if s == burn + keep - 1:  # noqa: B023
                    left = {"seats": b"", "crowds": b""}
                columns = word.tobytes(), _planes(c), _planes(kept), left["seats"], left["crowds"], int(tables.sum())
                yield pa.record_batch([pa.array([x], t) for x, t in zip(columns, SEATED.values(), strict=True)], list(SEATED))

        before, seated = seated, staged((counts if seated is None else seated).mapInArrow(run, SEATS))
        if before is not None:
            release(before)
        parent.totals.append(int(seated.agg(F.sum("total")).first()[0] or 0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, c, kept, _ in _seated(batches):
            p = parent.probability(c, kept, keep)
            for i in range(0, len(word), BLOCK >> 4):
                w = word[i : i + (BLOCK >> 4)]
                yield pa.record_batch([pa.array(shard_of(w, shards).astype(np.int32)), pa.array(w.view(np.int64)), pa.array(p[i : i + (BLOCK >> 4)])], ["shard", "word", "p"])

    out = seated.mapInArrow(score, "shard int, word long, p double")
    out._stored_at = seated._stored_at
    return parent, out


# ---- tokens and counts


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token of a buffer, each row's end token last."""
    data = LOWER[data]
    begin, end, row = words(data, offsets)
    n = len(offsets) - 1
    size = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    h = np.full(len(row) + n, END)
    h[np.arange(len(row)) + row] = word_hashes(data, begin, end)  # an end token goes after each row's words
    return h, np.repeat(np.arange(n), size + 1)


class Part:
    """The tokens of some texts as numbers of words and of pairs; contexts are in the order of their shards."""

    def __init__(self):
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, h: np.ndarray, row: np.ndarray) -> None:
        self.rows.append((h, np.r_[True, row[1:] != row[:-1]][: len(row)]))

    def number(self) -> np.ndarray:
        """The pair of each token; sets `words`, `contexts` (the words and START) and `END`'s number."""
        h, first = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        self.rows.clear()
        self.words, w = np.unique(h, return_inverse=True)
        names = np.r_[self.words, START]
        order = np.argsort(_spread(names))
        self.contexts = names[order]
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        self.place = place[:-1]  # of a word among the contexts
        before = np.r_[place[-1], place[w[:-1]]]
        before[first] = place[-1]
        self.word_of = w
        return before * len(self.words) + w

    def split(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of context and word."""
        return pair // len(self.words), pair % len(self.words)


def pair_seed(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(u) + w)


def _spread(u: np.ndarray) -> np.ndarray:
    return mix(u ^ np.uint64(0x5A5A5A5A5A5A5A5A))


def shard_of(u: np.ndarray, shards: int) -> np.ndarray:
    """Rises with _spread(u)."""
    return ((_spread(u) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 64-bit values, first all lowest bytes and so on: what is small compresses to little."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1).astype(np.int64)


# ---- parts ask, shards answer

ASK = "shard int, part int, contexts binary, sizes binary, followers binary, n binary"
STATE = "shard int, name string, seq int, data binary, more binary, ones long, twos long, customers long"
MOVED = {"shard": pa.int32(), "name": pa.string(), "seq": pa.int32(), "data": pa.binary(), "word": pa.int64(), "more": pa.int64()}
MOVES = "shard int, name string, seq int, data binary, word long, more long"
CHUNK = 4 << 20
ANSWER = {"part": pa.int32(), "shard": pa.int32(), "flags": pa.binary(), "n": pa.binary(), "tables": pa.binary(), "totals": pa.binary(), "seen": pa.binary(), "p": pa.binary()}
ANSWERS = "part int, shard int, flags binary, n binary, tables binary, totals binary, seen binary, p binary"


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of texts with their part; the rows of a part come one after another."""
    for b in batches:
        part = b.column("part").to_numpy()
        edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if j > i:
                for piece in slices(iter([b.slice(i, j - i)]), "text", 2 << 20):
                    yield int(part[i]), piece


def _ask(shards: int) -> Callable:
    def out(number: int, part: Part, learn: np.ndarray) -> Iterator[pa.RecordBatch]:
        code = np.sort(part.number() * 2 + learn)
        pair = code >> 1
        head = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        n = np.add.reduceat(code & 1, head)
        u, w = part.split(pair[head])
        at = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])  # the pairs of a context, and of a shard, are side by side
        context, size, follower = part.contexts[u[at]], np.diff(np.r_[at, len(u)]), part.words[w]
        shard = shard_of(context, shards)
        edges = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)].tolist()
        ends = np.r_[at, len(u)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            a, b = ends[i], ends[j]
            row = (int(shard[i]), number, context[i:j].tobytes(), _planes(size[i:j]), follower[a:b].tobytes(), _planes(n[a:b]))
            yield pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["shard", "part", "contexts", "sizes", "followers", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Part, list]] = {}
        for number, b in _whole_parts(batches):
            part, learn = held.setdefault(number, (Part(), []))
            h, row = tokens(*text_buffer(b.column("text")))
            part.add(h, row)
            learn.append(b.column("learn").to_numpy(zero_copy_only=False)[row])
        for number in list(held):
            part, learn = held.pop(number)
            yield from out(number, part, np.concatenate(learn))

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each shard is asked, merged: its state, and the words that follow its contexts."""
    held: dict[int, list] = {}
    for b in batches:
        for shard, *row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            held.setdefault(shard, []).append(row)

    def rows(shard: int, name: str, data: bytes, more: bytes = b"", *sums: int):
        for k, i in enumerate(range(0, max(1, len(data)), CHUNK)):
            values = (shard, name, k, data[i : i + CHUNK], more[i : i + CHUNK], *(sums if sums and not k else (None,) * 3))
            yield pa.record_batch([pa.array([x], t) for x, t in zip(values, (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 3), strict=True)], ["shard", "name", "seq", "data", "more", "ones", "twos", "customers"])

    for shard, asked in held.items():
        asked.sort(key=lambda r: r[0])
        context = np.concatenate([np.frombuffer(r[1], np.uint64) for r in asked])
        size = np.concatenate([_unplanes(r[2]) for r in asked])
        w = np.concatenate([np.frombuffer(r[3], np.uint64) for r in asked])
        n = np.concatenate([_unplanes(r[4]) for r in asked])
        shape = np.array([(r[0], len(r[1]) // 8, len(r[3]) // 8) for r in asked], np.int64)
        asked.clear()
        names, at = np.unique(context, return_inverse=True)
        of = np.repeat(at, size)
        key = pair_seed(of.astype(np.uint64), w)
        order = np.argsort(key)
        key = key[order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        total = np.add.reduceat(n[order], head)
        of, w = of[order[head]], w[order[head]]
        often = total >= 2
        kind = np.where(often, np.cumsum(often) + 1, total)  # 0 and 1: as often; else 2 and the number of the dish
        answer = np.empty(len(n), np.uint32)
        answer[order] = np.repeat(kind, np.diff(np.r_[head, len(n)]))
        seen = total > 0
        word, k = np.unique(w[seen], return_inverse=True)
        wanted = np.bincount(k, often[seen], len(word)) > 0
        yield from rows(shard, "words", word.tobytes(), (np.bincount(k, minlength=len(word)).astype("<u8") * np.uint64(2) + wanted.astype("<u8")).tobytes(), int((total == 1).sum()), int((total == 2).sum()), int(total.sum()))
        yield from rows(shard, "shape", shape.tobytes())
        yield from rows(shard, "at", at.astype(np.uint32).tobytes())
        yield from rows(shard, "answer", answer.tobytes())
        yield from rows(shard, "singles", np.bincount(of, total == 1, len(names)).astype(np.uint32).tobytes())
        yield from rows(shard, "dish_of", of[often].astype(np.uint32).tobytes())
        yield from rows(shard, "dish_word", w[often].tobytes())
        yield from rows(shard, "dish_n", _planes(total[often]))
        yield from rows(shard, "seen", _planes(np.bincount(of, total, len(names))))
        yield from rows(shard, "names", names.tobytes())


def _followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for shard, data, more in zip(*(b.column(c).to_pylist() for c in ("shard", "data", "more")), strict=True):
            word, k = np.frombuffer(data, np.int64), np.frombuffer(more, np.int64)
            for i in range(0, len(word), BLOCK):
                x = k[i : i + BLOCK]
                yield pa.record_batch([pa.array(np.full(len(x), shard, np.int32)), pa.array(word[i : i + BLOCK]), pa.array(x >> 1), pa.array((x & 1).astype(bool))], ["shard", "word", "c", "wanted"])


def _by_shard(batches: Iterator[pa.RecordBatch], sets: int = 1) -> Iterator[tuple[int, dict[str, bytes], np.ndarray, np.ndarray]]:
    """Each shard's state and the words that it is given, sorted, with their probabilities in each set."""
    states: dict[int, dict] = {}
    given: dict[int, list] = {}
    for b in batches:
        shard, name = b.column("shard").to_numpy(), b.column("name")
        at = np.flatnonzero(np.asarray(name.is_null()))
        if len(at):
            word, p, of = (b.column(c).take(pa.array(at)).to_numpy() for c in ("word", "p", "of"))
            for s in np.unique(shard[at]).tolist():
                mine = shard[at] == s
                given.setdefault(s, []).append((word[mine], p[mine], of[mine]))
        for i in np.flatnonzero(np.asarray(name.is_valid())).tolist():
            states.setdefault(int(shard[i]), {}).setdefault(name[i].as_py(), []).append((b.column("seq")[i].as_py(), b.column("data")[i].as_py()))
    for s in list(states):
        state = {k: b"".join(x for _, x in sorted(v)) for k, v in states.pop(s).items()}
        word, p, of = (np.concatenate(x) for x in zip(*given.pop(s, [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]), strict=True))
        word, k = np.unique(word.view(np.uint64), return_inverse=True)
        chance = np.zeros((sets, len(word)))
        chance[of, k] = p
        yield s, state, word, chance


def _seat(discount: float, joint: bool, kept: bool, last: bool) -> Callable:
    """What a turn leaves of each shard, and the tables of each word beyond one for each context.

    joint: the turn is one sweep that goes on from the last turn, and is kept for the averages or not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda **columns: pa.record_batch([columns.get(c, pa.nulls(len(next(iter(columns.values()))), t)) for c, t in MOVED.items()], list(MOVED))
        for shard, state, word, p in _by_shard(batches):
            get = lambda name, kind: np.frombuffer(state[name], kind)  # noqa: B023, E731
            n, of, w = _unplanes(state["dish_n"]), get("dish_of", np.uint32).astype(np.int64), get("dish_word", np.uint64)
            names, singles = get("names", np.uint64), get("singles", np.uint32).astype(np.int64)
            dishes = of, n, pair_seed(names[of], w), p[0, np.searchsorted(word, w)], singles, discount
            if joint:
                tables, totals, left = move_contexts(*dishes, state)
                left = {} if last else left
                dish_sum = tables
            else:
                left = {}
                tables, dish_sum, totals = seat_contexts(*dishes)
            if kept:
                before = [_unplanes(state.get(x, b"")) for x in ("dish_sum", "totals")]
                left |= {"dish_sum": _planes(dish_sum + (before[0] if len(before[0]) else 0)), "totals": _planes(np.r_[before[1], totals])}
            for name, data in left.items():
                for k, i in enumerate(range(0, max(1, len(data)), CHUNK)):
                    yield row(shard=pa.array([shard], pa.int32()), name=pa.array([name]), seq=pa.array([k], pa.int32()), data=pa.array([data[i : i + CHUNK]], pa.binary()))
            more, k = np.unique(w, return_inverse=True)
            extra = np.bincount(k, tables - 1, len(more)).astype(np.int64)
            for i in range(0, len(more), BLOCK):
                some = np.flatnonzero(extra[i : i + BLOCK]) + i
                yield row(word=pa.array(more[some].view(np.int64)), more=pa.array(extra[some]))

    return run


def _answer(unseen: list[float]) -> Callable:
    """What each part asked for: customers and tables of its pairs, and of its contexts the tables of each set of kept
    sweeps, the customers and the parent's probability as a word in each set (unseen: of a word that it has not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, state, word, p in _by_shard(batches, len(unseen)):
            get = lambda name, kind: np.frombuffer(state[name], kind)  # noqa: B023, E731
            names, answer, at, i, j = get("names", np.uint64), get("answer", np.uint32), get("at", np.uint32), 0, 0
            n, dish_sum, totals, seen = (_unplanes(state[x]) for x in ("dish_n", "dish_sum", "totals", "seen"))
            totals = totals.reshape(len(unseen), -1)
            own = np.repeat(np.array(unseen)[:, None], len(names), 1)
            if len(word):
                found = np.minimum(np.searchsorted(word, names), len(word) - 1)
                own = np.where(word[found] == names, p[:, found], own)
            for part, contexts, pairs in get("shape", np.int64).reshape(-1, 3).tolist():
                mine, context = answer[j : j + pairs].astype(np.int64), at[i : i + contexts]
                dish = mine[mine > 1] - 2
                columns = np.minimum(mine, 2).astype(np.uint8).tobytes(), _planes(n[dish]), _planes(dish_sum[dish]), _planes(totals[:, context].ravel()), _planes(seen[context]), own[:, context].tobytes()
                yield pa.record_batch([pa.array([x], t) for x, t in zip((part, shard, *columns), ANSWER.values(), strict=True)], list(ANSWER))
                i, j = i + contexts, j + pairs

    return run


# ---- scores

SCORE = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(discount: float, end: list[float], base_total: float, learned: int) -> Callable:
    """end: the parent's probabilities of the end token, which is no context; learned: the documents that train."""
    sets = len(end)  # of KEEP / sets sweeps each

    def out(answers: list, part: Part, docs: list) -> Iterator[pa.RecordBatch]:
        pair, inverse = np.unique(part.number(), return_inverse=True)
        u, w = part.split(pair)
        joined = lambda k: [x for x in (r[k] for r in sorted(answers, key=lambda r: r[0])) if x is not None]
        numbers = lambda k: np.concatenate([_unplanes(x) for x in joined(k)])
        flags = np.frombuffer(b"".join(joined(1)), np.uint8)
        n, tables = flags.astype(np.int64), flags * float(KEEP)
        n[flags == 2], tables[flags == 2] = numbers(2), numbers(3)
        asked = np.unique(u)  # in the order of the question; all contexts but the end token
        seen, top, p = np.zeros(len(part.contexts), np.int64), np.zeros(len(part.contexts)), np.zeros(len(part.contexts))
        seen[asked] = numbers(5)
        totals = np.concatenate([_unplanes(x).reshape(sets, -1) for x in joined(4)], 1)
        own = np.concatenate([np.frombuffer(x, float).reshape(sets, -1) for x in joined(6)], 1)
        back = np.zeros(len(u))
        for k in range(sets):
            p[:] = end[k]
            top[asked], p[asked] = STRENGTH + discount * totals[k] * sets / KEEP, own[k]
            back += top[u] * p[part.place[w]] / sets
        chance = (n - discount * tables / KEEP + back) / (STRENGTH + seen[u])
        score = np.log10(chance)[inverse]
        c = seen[part.place]
        c[part.words == END] = learned
        base = np.log10(c + 0.5) - base_total
        i = 0
        for ids, row in docs:
            n, word, j = len(ids), part.word_of[i : i + len(row)], i + len(row)
            yield pa.record_batch([ids, pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row, c[word] > 0, n).astype(np.int64)), pa.array(np.bincount(row, base[word], n)), pa.array(np.bincount(row, score[i:j], n))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers, part, docs = None, [], Part(), []
        for batch in batches:
            number, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            edges = np.r_[0, np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1, len(number)]
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if i == j:
                    continue
                piece = batch.slice(i, j - i)
                if number[i] != now:
                    if docs:
                        yield from out(answers, part, docs)
                    now, answers, part, docs = number[i], [], Part(), []
                if kind[i] == 0:
                    answers += zip(*(piece.column(c).to_pylist() for c in ("shard", "flags", "n", "tables", "totals", "seen", "p")), strict=True)
                    continue
                for b in slices(iter([piece]), "text", 2 << 20):
                    h, row = tokens(*text_buffer(b.column("text")))
                    part.add(h, row)
                    docs.append((b.column("doc_id"), row.astype(np.int32)))
        if docs:
            yield from out(answers, part, docs)

    return run


def score_documents(docs: DataFrame, learn_from, part_bytes: int = PART_BYTES, shard_bytes: int = SHARD_BYTES, joint: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity of every whole text.

    learn_from: a boolean column, true for the rows that the model learns from. joint: contexts and parent are sampled in
    turn, by single customers; else the contexts are, in groups, given the parent's first customers.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn_from, F.lit(True)).alias("learn"))
    size, learned = (x or 0 for x in docs.agg(F.sum(F.octet_length("text")), F.count_if("learn")).first())
    parts, shards = int(size // part_bytes) + 1, int(size // shard_bytes) + 1
    docs = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))

    asked = docs.select("part", "learn", "text").repartitionById(parts, "part").mapInArrow(_ask(shards), ASK)
    state = staged(asked.repartitionById(shards, "shard").mapInArrow(_merge, STATE))
    ones, twos, train_tokens = (int(x or 0) for x in state.agg(F.sum("ones"), F.sum("twos"), F.sum("customers")).first())
    discount = discount_of(ones, twos)
    pieces = lambda df, *names: df.where(F.col("name").isin(*names)).select("shard", "name", "seq", "data")
    followers = state.where("name = 'words'").select("shard", "data", "more").mapInArrow(_followers, "shard int, word long, c long, wanted boolean")
    first = staged(followers.groupBy("word").agg(F.sum("c").alias("c")))
    parent, p = seat_words(first, *FIRST_SWEEPS, shards, joint)
    counts, moved, sets = None, None, []  # sets: of kept sweeps, the parent and its probabilities
    turns = BURN + KEEP if joint else 1
    for turn in range(turns):
        kept, last = not joint or turn >= BURN, turn == turns - 1
        given = followers.where("wanted").select("shard", "word").join(p.drop("shard"), "word").withColumn("of", F.lit(0))
        to_seat = pieces(state, "names", "singles", "dish_of", "dish_word", "dish_n").unionByName(given, allowMissingColumns=True)
        if moved is not None:
            to_seat = to_seat.unionByName(pieces(moved, "seats", "crowds", "dish_sum", "totals"), allowMissingColumns=True)
        now = staged(to_seat.repartitionById(shards, "shard").mapInArrow(_seat(discount, joint, kept, last), MOVES))
        release(*(x for x in (moved, counts, p if not sets else None) if x is not None))  # kept ones answer later
        moved = now
        counts = staged(first.unionByName(moved.where("name is null").select("word", F.col("more").alias("c"))).groupBy("word").agg(F.sum("c").alias("c")))
        sweeps = FIRST_SWEEPS if joint else LAST_SWEEPS
        parent, p = seat_words(counts, *sweeps, shards, joint)
        if kept:
            seated, p = p, staged(p)
            release(seated)
            end = p.where(F.col("word") == int(END)).first()
            unseen = parent.unseen(sweeps[1])
            sets.append((p.withColumn("of", F.lit(len(sets))), unseen, end["p"] if end else unseen))
    release(first, counts)

    asks = pieces(state, "names", "at", "shape", "answer", "dish_n", "seen").unionByName(pieces(moved, "dish_sum", "totals"))
    for p, _, _ in sets:
        asks = asks.unionByName(p, allowMissingColumns=True)
    answers = staged(asks.repartitionById(shards, "shard").mapInArrow(_answer([x for _, x, _ in sets]), ANSWERS))
    release(state, moved)
    whole = answers.withColumn("kind", F.lit(0)).unionByName(docs.select("part", "doc_id", "text").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    base_total = float(np.log10(train_tokens + 0.5 * (parent.dishes + 1)))
    score = _score(discount, [x for _, _, x in sets], base_total, int(learned))
    out = whole.repartitionById(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(score, SCORE)
    return out.withColumn("train_tokens", F.lit(train_tokens).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents"), training_fold() != 1, joint=True)
    return out.select("doc_id", (training_fold() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
