"""Operator 1, quality rules: a ledger of rule bits and measurements, then versioned policies over the bits.

Every rule is evaluated once per document. The ledger keeps one bit per failed rule beside the measurements, so
that a new policy (another mask) or an ablation (what one rule alone removes) is bit arithmetic on the ledger and
never reads a text again.

Defined results: a null text has no words (all measurements 0, bit TOO_FEW_WORDS set); repeated rows and null ids
give one row each; bytes that are no UTF-8 are no space, symbol or letter, and count as characters unless they look like
the rest of one; further columns are ignored; an empty table gives an empty ledger. A text is one row and held whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, numbered, slices, small_batches, stored, window_hashes

SYMBOLS = b"#*$%&|<>"
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: All bytes of a code point but the first; capitals.
FURTHER, UPPER = bytes(range(0x80, 0xC0)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REPEAT_WORDS = 8

LEDGER = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_upper long, n_letters long"


@dataclass(frozen=True)
class Rule:
    """A named rule: ``fails`` is a boolean expression over the ledger's measurements."""

    bit: int
    name: str
    fails: str


#: Integer arithmetic only, so that every engine gives the same verdicts.
RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule(5, "capitals", "2 * n_upper > n_letters"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a document is dropped if it fails any rule of ``rules``."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_windows"))
POLICIES = (BASE, Policy("v1", ("too_few_words", "repeated_windows", "symbols")), Policy("v2", tuple(r.name for r in RULES)))


def measurements(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ledger's measurements of each text, from (doc_id, text)."""
    def number(texts: list[bytes], without: bytes) -> np.ndarray:
        """The bytes of each text that are not of ``without``."""
        return np.fromiter((len(t.translate(None, without)) for t in texts), np.int64, len(texts))

    for ids, texts in slices(batches):
        texts = [t or b"" for t in texts]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        n_symbols = size - number(texts, SYMBOLS)
        word_chars = number(texts, SPACES + FURTHER)
        n_upper = size - number(texts, UPPER)
        n_letters = size - number(texts, UPPER + UPPER.lower())
        words, bounds, _ = numbered(t.split() for t in texts)
        n_words = np.diff(bounds)
        repeated = repeated_words(words, bounds)
        lines = [[x for x in t.split(b"\n") if x.strip()] if b"\n" in t else [t] if t.strip() else [] for t in texts]
        n_lines = np.fromiter(map(len, lines), np.int64, len(lines))
        n_dup = n_lines - np.fromiter((len(set(x)) for x in lines), np.int64, len(lines))
        columns = (n_words, word_chars, n_symbols, n_dup, n_lines, repeated, n_upper, n_letters)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], LEDGER_NAMES)


LEDGER_NAMES = [x.split()[0] for x in LEDGER.split(", ")]


def repeated_words(words: np.ndarray, bounds: np.ndarray, width: int = REPEAT_WORDS) -> np.ndarray:
    """Per document, how many of its words lie in a window of ``width`` words found at least twice in it."""
    n = len(words)
    out = np.zeros(len(bounds) - 1, np.int64)
    if n < width:
        return out
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    hashed = window_hashes(words.astype(np.uint64) + np.uint64(1), width)[inside]
    hashed ^= (doc[inside].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(hashed, kind="stable")
    h = hashed[order]
    same = np.zeros(len(h), bool)
    equal = h[1:] == h[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    edge = np.zeros(n + 1, np.int64)
    starts = inside[order[same]]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(out)).astype(np.int64)


def failure_bits() -> Column:
    """The bitmask of failed rules."""
    total = F.lit(0).cast("long")
    for r in RULES:
        total = total.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return total


def ledger(docs: DataFrame) -> DataFrame:
    """Store doc_id, the measurements and ``failed`` (one bit per rule) of every document: policies and ablations, of now
    or later, read this table and no text."""
    small_batches(docs.sparkSession)
    return stored(id_text(docs).mapInArrow(measurements, LEDGER).withColumn("failed", failure_bits()), "ledger")


def judged(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with the verdict of one policy: ``kept`` and the bits that decided it."""
    decided = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    return book.withColumn("policy", F.lit(policy.version)).withColumn("deciding", decided).withColumn("kept", decided == 0)


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (kept without it), and all rows.

    The ledger is first counted by bitmask (at most 2 ** len(RULES) rows), so the rest is independent of its size.
    """
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("m")).count()
    bits = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("b")) for r in RULES if r.name in policy.rules])
    rows = masks.select("m", "count", F.explode(bits).alias("r")).select("m", "count", "r.rule", "r.b")
    return rows.groupBy("rule").agg(
        F.sum(F.when(F.col("m").bitwiseAND(F.col("b")) != 0, F.col("count")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("m") == F.col("b"), F.col("count")).otherwise(0)).alias("failing_alone"),
        F.sum("count").alias("documents"),
    ).withColumn("policy", F.lit(policy.version))
