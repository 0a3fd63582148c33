"""Best-fit packing of tokenised documents under several capacities at once.

`cut_documents` tokenises whole texts and cuts what is longer than a sequence; `plan_bins` runs vector best-fit,
longest pieces first, and `pack` gives every piece its sequence and offset.

The plan is made from the histogram of piece lengths, which has at most one entry per length up to the capacity however
large the input is: pieces of one length are alike, and so are bins with one residual vector (tokens, documents,
attention cost as the sum of squared lengths), so both are handled as counted classes. For each length the feasible
class with the best score takes pieces: the smallest weighted norm of what would remain ("norm"), or the largest
weighted dot product of need and residual ("dot"). No piece has to meet the others in one task: its rank among the
pieces of its length, dealt over salted buckets with prefix sums between them, tells its place in the plan.

Tokens are those of `tokenizers` for the byte-level BPE file given as `vocabulary`; they are computed by `tiktoken`
from the same vocabulary as ranks, which gives the same ids (tested) four times as fast, special strings included.

Defined results: null and empty texts are the closing token alone; repeated rows are packed as often as they occur; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, staged, table
from .token_counts import byte_letters

END_ID = 2
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one bucket of a length has on average; a common length has many buckets.
BUCKET_PIECES = 1000


@dataclass(frozen=True)
class Capacity:
    tokens: int = 1024
    docs: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)


_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str):
    """The encoder of a `tokenizers` byte-level BPE file, one for each worker process."""
    if vocabulary not in _ENCODERS:
        import json

        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _ENCODERS[vocabulary] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[vocabulary]


def document_ids(text: str | None, vocabulary: str) -> np.ndarray:
    return np.append(encoder(vocabulary).encode_to_numpy(text or "", allowed_special="all"), np.uint32(END_ID)).astype("<u4")


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: the first one takes what the others, of `capacity` tokens each, leave over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = document_ids(text, vocabulary)
                head = len(ids) % capacity or capacity
                edges = [0, *range(head, len(ids) + 1, capacity)]
                for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc, k, i, j - i, zlib.crc32(ids[i:j].tobytes()), *([ids[i:j].tolist()] if keep_ids else [])))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * keep_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE_SCHEMA + (", ids array<long>" if keep_ids else ""))


def plan_bins(histogram: dict[int, int], capacity: Capacity = Capacity(), rule: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """Moves (length, from_rank, to_rank, first_bin, per_bin, offset): pieces of the ranks fill bins, per_bin each."""
    limit = np.array([capacity.tokens, capacity.docs, capacity.cost], float)
    weight = np.array(capacity.weights)
    classes: dict[tuple[int, int, int], list[list[int]]] = {}
    keys = np.zeros((0, 3), np.int64)
    moves, bins = [], 0

    def stack(room, need) -> int:
        return int(min(r // n for r, n in zip(room, need, strict=True)))

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > limit).any():
            raise ValueError(f"a piece of {length} tokens is above a capacity")
        while count:
            fits = np.flatnonzero((keys >= need).all(1))
            if len(fits):
                left = keys[fits]
                score = -(((left - need) / limit) ** 2 @ weight) if rule == "norm" else (left / limit) @ (weight * need / limit)
                key = tuple(int(x) for x in left[np.argmax(score)])
                free = classes[key]
            else:
                key = (capacity.tokens, capacity.docs, capacity.cost)
                new = -(-count // stack(key, need))
                free = classes.setdefault(key, [])
                free.append([bins, new])
                bins += new
            per = min(stack(key, need), count) if count else 1
            first, there = free[-1]
            full = min(there, count // per)
            if full == 0:
                full, per = 1, count
            taken = full * per
            moves.append((length, rank, rank + taken, first, per, capacity.tokens - key[0]))
            rank, count = rank + taken, count - taken
            if full == there:
                free.pop()
            else:
                free[-1] = [first + full, there - full]
            rest = tuple(int(k - per * n) for k, n in zip(key, need, strict=True))
            if rest[0] > 0 and rest[1] > 0:
                classes.setdefault(rest, []).append([first, full])
            if not free:
                classes.pop(key, None)
            keys = np.array(list(classes), np.int64).reshape(-1, 3)
    return moves


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), rule: str = "norm") -> DataFrame:
    """pieces with sequence_id and offset. `pieces` is read several times: it should be a stored table."""
    spark = pieces.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # an entry per length up to the capacity
    deal = spark.createDataFrame([(k, -(-n // BUCKET_PIECES)) for k, n in histogram.items()], "length long, buckets long")
    dealt = pieces.join(F.broadcast(deal), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets"))).drop("buckets")
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    moves = plan_bins(histogram, capacity, rule)
    if not moves:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(own) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    plan = spark.createDataFrame([tuple(map(int, m)) for m in moves], "of_length long, lo long, hi long, first_bin long, per_bin long, at long")
    if len(moves) <= 200_000:
        plan = F.broadcast(plan)
    placed = ranked.join(plan, (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        *pieces.columns,
        F.expr("first_bin + (rank - lo) div per_bin").cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: Capacity = Capacity(), rule: str = "norm") -> DataFrame:
    return pack(staged(cut_documents(docs, vocabulary, capacity.tokens)), capacity, rule)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
