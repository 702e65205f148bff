"""Operator 6, language identification: multinomial logistic regression on TF-IDF of character n-grams.

1. Document frequencies of hashed character n-grams (1 to 3 letters, words apart by a blank, all else as a blank) are
   counted over all documents that may be learned from; their number is bounded by ``BUCKETS``.
2. A bounded sample (``PER_LANGUAGE`` distinct documents of each language, by a hash of id and text) trains the weights with
   follow-the-regularised-leader (FTRL-proximal, per coordinate) under an elastic net (L1 and L2).
3. A fifth of the sample is kept out of the training and sets the temperature of the softmax.
4. Every whole text is scored with the broadcast weights (``BUCKETS`` x languages).

Defined results: a null text or one without a letter is ``und`` with score 0; rows without a language teach nothing; with
no learnable row at all everything is ``und``; bytes that are no UTF-8 are no letters; repeated rows and null ids give one
row each; further columns are ignored. A text is counted in pieces of ``PIECE_CHARS`` characters, so the memory beside
the text itself is bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, decoded, id_text, mix64, release_memory, slices, small_batches, text_digest

BUCKETS = 1 << 15
PER_LANGUAGE = 800
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.01
UNKNOWN = "und"
#: Characters of a text that are counted at once.
PIECE_CHARS = 1 << 20

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def normal_pieces(text: str) -> Iterator[np.ndarray]:
    """The code points of the text in lower case, letters only, with one blank after each run of them; piece by piece."""
    after_letter = False
    for at in range(0, len(text), PIECE_CHARS):
        code = np.frombuffer(text[at : at + PIECE_CHARS].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = letters()[code]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= after_letter
        after_letter = bool(letter[-1])
        yield np.where(letter, code, np.uint32(32))[keep]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the text's n-grams and how often each occurs; empty if it has no letter."""
    total, seen = np.zeros(BUCKETS, np.int64), False
    last = np.array([32], np.uint64)  # the code points before the piece that its n-grams reach
    new = 1  # of which so many are not counted yet
    pieces = normal_pieces(text)
    while True:
        piece = next(pieces, None)
        if piece is None and not seen:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = seen or bool((piece != 32).any())
        more = np.array([32], np.uint64) if piece is None else piece.astype(np.uint64)
        code, old = np.concatenate([last, more]), len(last) - new
        pair = code[:-1] * np.uint64(0x110000) + code[1:]
        triple = pair[:-1] * np.uint64(0x110000) + code[2:]
        hashed = mix64(np.concatenate([code[old:], pair[max(old - 1, 0) :] + np.uint64(1 << 48), triple[max(old - 2, 0) :]]))
        total += np.bincount((hashed >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
        if piece is None:
            used = np.flatnonzero(total)
            return used, total[used]
        last, new = code[-2:], 0


def frequency_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): in how many texts of the task each bucket occurs; bucket -1 counts the texts."""
    total, n = np.zeros(BUCKETS, np.int64), 0
    for _, texts in slices(batches):
        for t in texts:
            total[gram_counts(decoded(t))[0]] += 1
            n += 1
    used = np.flatnonzero(total)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int64()), pa.array([n, *total[used].tolist()], pa.int64())], ["bucket", "n"])


def feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, buckets, counts) of (lang, text)."""
    for langs, texts in slices(batches):
        found = [gram_counts(decoded(t)) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([b.astype("<u4").tobytes() for b, _ in found], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())], ["lang", "buckets", "counts"])


@dataclass
class Model:
    """Languages, idf of each bucket, weights (bucket x language), biases, temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vector(self, counts: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[buckets]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def logits(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(counts, buckets) @ self.weights[buckets] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        buckets, counts = gram_counts(text)
        if not len(buckets) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(buckets, counts) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """FTRL-proximal over the rows (language, buckets, counts), every fifth of which calibrates."""
    languages = sorted({r[0] for r in rows})
    k = len(languages)
    model = Model(languages, idf, np.zeros((BUCKETS, k), np.float64), np.zeros(k), 1.0)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    data = [(languages.index(lang), np.append(b, BUCKETS), np.append(model.vector(c, b), 1.0)) for lang, b, c in rows if len(b)]
    held, learned = data[::5], [d for i, d in enumerate(data) if i % 5]
    rng = np.random.default_rng(7)

    def weights(at) -> np.ndarray:
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(learned)):
            y, b, x = learned[i]
            w = weights(b)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            squares = n[b] + g * g
            z[b] += g - (np.sqrt(squares) - np.sqrt(n[b])) / ALPHA * w
            n[b] = squares
    all_weights = weights(slice(None))
    model.weights, model.bias = all_weights[:BUCKETS].astype(np.float32), all_weights[BUCKETS]
    if held:
        logits = np.array([x @ all_weights[b] for _, b, x in held])
        truth = np.array([y for y, _, _ in held])
        model.temperature = best_temperature(logits, truth)
    return model


def best_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of the least log loss, of a grid."""

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), truth]).mean())

    return min(np.geomspace(0.05, 5, 60).tolist(), key=loss)


def fit(docs: DataFrame, learnable: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Train on the rows of ``docs`` (doc_id, text, lang) for which ``learnable`` holds."""
    small_batches(docs.sparkSession)
    usable = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counted = id_text(usable).mapInArrow(frequency_rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency = {r.bucket: r.n for r in counted.collect()}  # at most BUCKETS + 1 rows
    total = frequency.pop(-1, 0)
    idf = np.full(BUCKETS, np.log1p(total) + 1)
    for b, n in frequency.items():
        idf[b] = np.log((1 + total) / (1 + n)) + 1
    keyed = usable.select("doc_id", text_digest().alias("digest"), "lang", "text")
    chosen = bounded_sample(keyed.select("doc_id", "digest", "lang"), per_language, "lang", ("doc_id", "digest"))
    chosen = chosen.select(*[F.col(c).alias(f"__{c}") for c in chosen.columns])
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("digest") == F.col("__digest")) & (F.col("lang") == F.col("__lang"))
    picked = keyed.join(F.broadcast(chosen), same, "left_semi").dropDuplicates(["doc_id", "digest", "lang"]).select("lang", "text")
    rows = picked.mapInArrow(feature_rows, "lang string, buckets binary, counts binary").collect()  # ``per_language`` of each
    data = sorted((r.lang, bytes(r.buckets), bytes(r.counts)) for r in rows)
    turns = np.random.default_rng(3).permutation(len(data))
    return train([(data[i][0], np.frombuffer(data[i][1], "<u4").astype(np.int64), np.frombuffer(data[i][2], "<u4")) for i in turns], idf)


def predicted_rows(shared):
    """A mapper from (doc_id, text) to (doc_id, lang_pred, score)."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            found = [shared.value.predict(decoded(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return build


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(predicted_rows(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")


def accepted_rows(shared, least: float):
    """A mapper that keeps whole rows whose ``text`` is in a known language with a score of at least ``least``."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist()
            found = [shared.value.predict(decoded(t)) for t in texts]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))
        release_memory()

    return build


def accepted(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The rows in a known language, all columns as they are."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(accepted_rows(docs.sparkSession.sparkContext.broadcast(model), least), docs.schema)
