"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages, the consecutive PASSAGE-byte windows of its whole text. A passage is encoded from how
often byte classes follow each other, and from how many of its words repeat what stands before. A hidden layer, gated
attention (tanh and sigmoid branches) and a linear output are learnt from document labels alone; the attention weights
give the weighted passage representation that is scored.

Learning takes a bounded sample of labelled documents: at most SAMPLE in all, balanced over the two labels, chosen by a
hash of the id among those of at most SAMPLE_PASSAGES passages, so the driver holds a fixed amount however large the
corpus is. Scoring covers every passage of every document. Label, language, source and id are never inputs.

Defined results: null and empty texts are one passage without bytes and get the score of that; repeated rows each return
the same score; without labels, or with labels of one value only, the score is the share of label 1 (0.5 without any); an
empty table gives no rows; other columns are carried along by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, slices, table, text_buffer, training_fold, word_hashes, words

PASSAGE = 512
SAMPLE = 3000
SAMPLE_PASSAGES = 64
HIDDEN, GATE = 32, 16
THRESHOLD = 0.3

_GROUPS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",;:", "!?", "#*$%&|<>", "\"'()[]{}-_", "@/\\=+~^`"]
CLASSES = len(_GROUPS) + 3
CLASS = np.full(256, len(_GROUPS), np.uint8)  # control characters and the rest
for _i, _group in enumerate(_GROUPS):
    CLASS[[ord(c) for c in _group]] = _i
CLASS[0x80:0xC0], CLASS[0xC0:] = CLASSES - 2, CLASSES - 1
FEATURES = CLASSES * CLASSES + 4


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a buffer of texts, and the first passage of each row (and one end)."""
    sizes = np.diff(offsets)
    count = np.maximum(1, -(-sizes // PASSAGE))
    first = np.r_[0, np.cumsum(count)]
    n = int(first[-1])
    row = np.repeat(np.arange(len(sizes)), sizes)
    passage = first[row] + (np.arange(len(data)) - offsets[row]) // PASSAGE
    kind = CLASS[data].astype(np.int64)
    follow = np.r_[kind[1:], 0]
    inside = np.r_[row[1:] == row[:-1], False] if len(row) else np.zeros(0, bool)
    cell = (passage * CLASSES + kind) * CLASSES + follow
    pairs = np.bincount(cell[inside], minlength=n * CLASSES * CLASSES).reshape(n, -1).astype(np.float32)
    begin, end, of = words(data, offsets)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :-4] = np.sqrt(pairs / np.maximum(1, pairs.sum(1, keepdims=True)))
    at = passage[begin] if len(begin) else begin
    total = np.maximum(1, np.bincount(at, minlength=n))
    if len(begin):
        w = word_hashes(data, begin, end)
        same = np.r_[False, (w[1:] == w[:-1]) & (of[1:] == of[:-1])]
        three = mix(w + mix(np.roll(w, -1) + np.uint64(1)) + mix(np.roll(w, -2) + np.uint64(2)) + mix(of.astype(np.uint64)))
        whole = np.r_[of[2:] == of[:-2], False, False] if len(of) > 2 else np.zeros(len(of), bool)
        where = np.flatnonzero(whole)
        order = where[np.lexsort((where, three[where]))]
        seen = np.zeros(len(w), bool)
        seen[order[1:]] = three[order[1:]] == three[order[:-1]]
        out[:, -4] = np.bincount(at[same], minlength=n) / total
        out[:, -3] = np.bincount(at[seen], minlength=n) / total
    out[:, -2] = np.log1p(np.bincount(passage, minlength=n)) / 6 if len(passage) else 0
    out[first[:-1][sizes == 0], -1] = 1
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Weights of the hidden layer, the two gates, attention and output; or only a constant score."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.weights, {}
        f["x"] = (x - self.mean) / self.scale
        f["h"] = np.tanh(f["x"] @ p["w"] + p["b"])
        f["v"], f["u"] = np.tanh(f["h"] @ p["v"]), _sigmoid(f["h"] @ p["u"])
        score = (f["v"] * f["u"]) @ p["a"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(score - np.maximum.reduceat(score, first[:-1])[bag])
        f["bag"], f["att"] = bag, e / np.add.reduceat(e, first[:-1])[bag]
        f["z"] = np.add.reduceat(f["att"][:, None] * f["h"], first[:-1])
        f["y"] = _sigmoid(f["z"] @ p["c"] + p["d"])
        return f

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        return np.full(len(first) - 1, self.constant) if self.constant is not None else self.forward(x, first)["y"].astype(float)


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 120, rate: float = 0.01, decay: float = 1e-3) -> Model:
    """Full-batch Adam on the weighted log loss of the document labels."""
    mean, scale = (x.mean(0), x.std(0) + 0.02) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    if len(set(y.tolist())) < 2:
        return Model({}, mean, scale, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(7)
    shapes = {"w": (FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": ()}
    p = {k: (rng.normal(0, 1 / np.sqrt(s[0]) if s else 1, s) if k not in "bd" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    model = Model(p, mean.astype(np.float32), scale.astype(np.float32))
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    for step in range(1, epochs + 1):
        f = model.forward(x, first)
        dy = (weight * (f["y"] - y)).astype(np.float32)
        g = {"c": f["z"].T @ dy, "d": dy.sum()}
        dz = dy[:, None] * p["c"]
        lift = (f["h"] * dz[f["bag"]]).sum(1)
        ds = f["att"] * (lift - np.add.reduceat(f["att"] * lift, first[:-1])[f["bag"]])
        gate = f["v"] * f["u"]
        g["a"] = gate.T @ ds
        dg = ds[:, None] * p["a"]
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        g["v"], g["u"] = f["h"].T @ dv, f["h"].T @ du
        dh = (f["att"][:, None] * dz[f["bag"]] + dv @ p["v"].T + du @ p["u"].T) * (1 - f["h"] ** 2)
        g["w"], g["b"] = f["x"].T @ dh, dh.sum(0)
        for k in p:
            grad = g[k] + (decay * p[k] if k in "wvuc" else 0)
            m, s = moments[k]
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
            moments[k] = (m, s)
            p[k] = (p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_passages: int = SAMPLE_PASSAGES) -> Model:
    """A model of labels.quality from at most `sample` documents of the training folds (remainder of the id not 0)."""
    known = labels.where("quality in (0, 1)").where(training_fold() != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for q in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most `sample` rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_passages * PASSAGE).join(chosen, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 19):
            x, first = encode(*text_buffer(b.column("text")))
            packed = [x[i:j].astype(np.float16).tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("quality").cast(pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "quality", "x"])

    got = sorted(rows.mapInArrow(run, "doc_id long, quality int, x binary").collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    bags = [np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES) for r in got]
    x = np.concatenate(bags).astype(np.float32) if bags else np.zeros((0, FEATURES), np.float32)
    return fit(x, np.r_[0, np.cumsum([len(b) for b in bags])].astype(np.int64), np.array([r["quality"] for r in got]))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) with the score of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 19):
            yield pa.record_batch([b.column("doc_id"), pa.array(model.score(*encode(*text_buffer(b.column("text")))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores `threshold` or more, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 19):
            yield b.filter(pa.array(model.score(*encode(*text_buffer(b.column("text")))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (training_fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
