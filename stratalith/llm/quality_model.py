"""Operator 8, quality classifier: random-indexing word vectors, pooled per document, then a two-layer network.

1. Texts are cut into pieces: words in lower case with a mark of their case, and runs of other signs. A piece has a
   bucket (of ``BUCKETS``) and a sparse index vector (``ONES`` of ``DIMS`` places are +1 or -1) that follow from its hash.
2. The context vector of a bucket is the sum of the index vectors of the pieces within ``REACH`` places of its
   occurrences, over the whole corpus; so are the counts. Tasks add up their own texts; their sums meet in a tree of
   groups of at most ``FAN_IN``.
3. A document's vector pools the context vectors of its pieces, weighted by rarity (mean and spread), and the shares of
   the kinds of pieces and of immediate repeats.
4. A bounded sample of labelled documents (``PER_LABEL`` of each label) trains a two-layer network in numpy; a second
   one, ``CALIBRATION`` rows with the labels' own frequencies, sets the temperature and the offset of its probabilities.

Defined results: null and empty texts get the score of a text without pieces; without labels every score is 0.5; repeated
rows and null ids give one row each; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, id_text, mix64, numbered, slices, small_batches, stored, text_digest

BUCKETS, DIMS, ONES, REACH = 1 << 13, 64, 4, 2
FAN_IN = 32
PER_LABEL, CALIBRATION = 1000, 1000
HIDDEN, EPOCHS, RATE, DECAY = 24, 40, 0.01, 1e-4
THRESHOLD = 0.3
#: Rows of the matrix that one row of a task's output holds.
CHUNK = 512

PIECE = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+").findall
N_KINDS = 5  # lower, capitalised, all capitals, digits, signs


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    h = mix64(np.arange(BUCKETS * ONES, dtype=np.uint64) + np.uint64(11)).reshape(BUCKETS, ONES)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1).astype(np.int64)


def kind_of(piece: bytes) -> int:
    if piece.isdigit():
        return 3
    if not (piece[0] >= 0x80 or piece[:1].isalpha()):
        return 4
    if piece.isupper() and len(piece) > 1:
        return 2
    return 1 if 65 <= piece[0] <= 90 else 0


def pieces(texts: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and kinds of all pieces, and the bounds of each text's."""
    at, bounds, vocab = numbered(PIECE(t or b"") for t in texts)
    kinds = np.fromiter(map(kind_of, vocab), np.int64, len(vocab))
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(p.lower()) for p in vocab), np.uint64, len(vocab))
    bucket = ((hashed + (kinds == 2).astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    return bucket[at], kinds[at], bounds


def context_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, part, sums): the task's context sums and, in a last column, counts; none for a task without text."""
    from pyspark import TaskContext

    place, sign = index_vectors()
    total = np.zeros((BUCKETS, DIMS + 1), np.int64)
    some = False
    for _, texts in slices(batches):
        bucket, _, bounds = pieces(texts)
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        some = some or len(bucket) > 0
        sums = np.zeros(BUCKETS * DIMS)
        for step in range(1, REACH + 1):
            same = doc[:-step] == doc[step:]
            a, b = bucket[:-step][same], bucket[step:][same]
            for x, y in ((a, b), (b, a)):
                for k in range(ONES):
                    sums += np.bincount(x * DIMS + place[y, k], weights=sign[y, k], minlength=BUCKETS * DIMS)
        total[:, :DIMS] += sums.reshape(BUCKETS, DIMS).astype(np.int64)
        total[:, DIMS] += np.bincount(bucket, minlength=BUCKETS)
    if some:
        part = TaskContext.get().partitionId()
        parts = [total[c : c + CHUNK].tobytes() for c in range(0, BUCKETS, CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(np.full(len(parts), part)), pa.array(parts, pa.binary())], ["chunk", "part", "sums"])


def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(s, np.int64) for s in pdf.sums], axis=0)
    return pd.DataFrame({"chunk": [pdf.chunk.iloc[0]], "part": [pdf.part.iloc[0] // FAN_IN], "sums": [total.tobytes()]})


def corpus_sums(docs: DataFrame) -> np.ndarray:
    """The context sums and counts (BUCKETS x DIMS + 1) of all documents."""
    rows = id_text(docs).mapInArrow(context_rows, "chunk long, part long, sums binary")
    rows = stored(rows, "contexts")
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        rows = rows.groupBy("chunk", F.floor(F.col("part") / FAN_IN).alias("g")).applyInPandas(add_up, "chunk long, part long, sums binary")
        parts = -(-parts // FAN_IN)
    total = np.zeros((BUCKETS, DIMS + 1), np.int64)
    for r in rows.collect():  # BUCKETS / CHUNK rows
        total[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.sums, np.int64).reshape(CHUNK, DIMS + 1)
    return total


@dataclass
class Vectors:
    """Unit context vectors and rarity weights of the buckets."""

    vectors: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray) -> Vectors:
        context, counts = sums[:, :DIMS].astype(np.float64), sums[:, DIMS]
        context -= context.sum(axis=0) / max(1, counts.sum()) * counts[:, None]  # what every piece would have
        size = np.sqrt((context**2).sum(axis=1, keepdims=True))
        share = counts / max(1, counts.sum())
        return cls((context / np.maximum(size, 1e-9)).astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32))

    def pooled(self, texts: list[bytes | None]) -> np.ndarray:
        """A row of features for each text."""
        bucket, kind, bounds = pieces(texts)
        out = np.zeros((len(texts), FEATURES), np.float32)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            n = b - a
            out[i, -1] = np.log1p(n)
            if not n:
                continue
            at, times = np.unique(bucket[a:b], return_counts=True)
            w = self.weights[at] * times
            v = self.vectors[at]
            mean = w @ v / w.sum()
            out[i, :DIMS] = mean
            out[i, DIMS : 2 * DIMS] = np.sqrt(np.maximum(w @ (v * v) / w.sum() - mean * mean, 0))
            out[i, 2 * DIMS : 2 * DIMS + N_KINDS] = np.bincount(kind[a:b], minlength=N_KINDS) / n
            out[i, -3] = len(at) / n
            out[i, -2] = (bucket[a + 1 : b] == bucket[a : b - 1]).mean() if n > 1 else 0
        return out


FEATURES = 2 * DIMS + N_KINDS + 3


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` and ``offset`` calibrate."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    offset: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.offset, -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss, both labels with equal weight."""
    rng = np.random.default_rng(17)
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-3, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    z = np.clip((x - net.mean) / net.scale, -6, 6)
    weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 64):
            i = order[lo : lo + 64]
            h = np.maximum(z[i] @ params[0] + params[1], 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            d = (p - y[i]) * weight[i] / len(i)
            dh = np.outer(d, params[2]) * (h > 0)
            t += 1
            for k, g in enumerate((z[i].T @ dh, dh.sum(axis=0), h.T @ d, np.array([d.sum()]))):
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= RATE * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + DECAY * params[k])
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> None:
    """The temperature and offset of the least log loss, of a grid."""
    logits = net.logits(x)
    best = np.inf
    for t in np.geomspace(0.3, 10, 30):
        for o in np.linspace(-4, 4, 33):
            s = np.clip(logits / t + o, -40, 40)
            loss = float((np.logaddexp(0, s) - y * s).mean())
            if loss < best:
                best, net.temperature, net.offset = loss, float(t), float(o)


def sampled_rows(shared):
    """A mapper from (label and purpose, text) to (the same, features)."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tags, texts in slices(batches):
            x = shared.value.pooled(texts)
            yield pa.RecordBatch.from_arrays([pa.array(tags, pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], ["tag", "x"])

    return build


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, name: str = "quality") -> tuple[Vectors, Network | None]:
    """Word vectors from all documents; a network from the labels for which ``learnable`` (over doc_id) holds."""
    spark = docs.sparkSession
    small_batches(spark)
    vectors = Vectors.of(corpus_sums(docs))
    known = labels.select("doc_id", name).where(learnable & F.col(name).isin(0, 1)).groupBy("doc_id").agg(F.max(name).cast("long").alias("y"))
    known = known.withColumn("use", F.when(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0, 1).otherwise(0))
    first = bounded_sample(known.where("use = 0"), PER_LABEL, "y").withColumn("use", F.lit(0))
    second = bounded_sample(known.where("use = 1").withColumn("all", F.lit(0)), CALIBRATION, "all").drop("all").withColumn("use", F.lit(1)).join(known.select("doc_id", "y"), "doc_id")
    chosen = first.unionByName(second).select(F.col("doc_id").alias("__id"), (F.col("y") * 2 + F.col("use")).alias("tag"))
    shared = spark.sparkContext.broadcast(vectors)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    picked = picked.groupBy("doc_id", "tag").agg(F.min_by("text", text_digest()).alias("text")).select("tag", "text")  # of repeated ids one text
    rows = picked.mapInArrow(sampled_rows(shared), "tag long, x binary").collect()  # 2 * PER_LABEL + CALIBRATION at most
    data = sorted((r.tag, bytes(r.x)) for r in rows)
    if not data:
        return vectors, None
    tags, x = np.array([t for t, _ in data]), np.array([np.frombuffer(b, np.float32) for _, b in data]).astype(np.float64)
    y, use = tags // 2, tags % 2
    net = train(x[use == 0], y[use == 0]) if (use == 0).any() else None
    if net is not None and (use == 1).any():
        calibrate(net, x[use == 1], y[use == 1])
    return vectors, net


def scored_rows(shared):
    """A mapper from (doc_id, text) to (doc_id, score)."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for ids, texts in slices(batches):
            scores = net.scores(vectors.pooled(texts)) if net is not None else np.full(len(ids), 0.5)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return build


def scores(docs: DataFrame, vectors: Vectors, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))
    return id_text(docs).mapInArrow(scored_rows(shared), "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
