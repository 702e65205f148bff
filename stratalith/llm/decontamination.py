"""Operator 2, benchmark decontamination: a positional inverted index over the documents, queried from the rarest term.

``build_index`` stores posting lists as a table of rows (block, term, n, positions): a block is a run of documents of
bounded size, a position counts the words of the block with a gap after each document, so that no phrase crosses two.
``phrase_hits`` reads the list of each query window's rarest term (by counts over the whole index), shifts it by the
term's place in the window, and intersects it with the shifted lists of the other terms in the order of rarity. With
``slop`` above 0 the same walk returns proximity matches: every term within ``slop`` positions of its place, in one document.

Blocks are independent, so a frequent term or a passage that many documents share is spread over as many blocks as
the documents are. Benchmarks are taken in chunks of at most ``CHUNK_BYTES``; one chunk is what is broadcast.

Defined results: null texts have no words; repeated rows and null ids give one row each; an empty benchmark or an empty
table of documents gives no hits or no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, numbered, slices, small_batches, stored

WINDOW = 10
BLOCK_BYTES = 6 << 20
#: The text of a benchmark that one pass over the index takes (its windows are broadcast).
CHUNK_BYTES = 32 << 20
#: Candidate places that one numpy step holds.
STEP = 1 << 20

#: a-z stay, A-Z become a-z, digits and bytes above 127 stay, all others part words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

INDEX = "block string, term binary, n long, positions binary"
INDEX_NAMES = ["block", "term", "n", "positions"]
RESULT = "block string, place long, doc_id long, digest binary, n_words long, n_hit long, hits binary, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def posting_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of (doc_id, text): a block's directory, then its lists."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for number, (ids, texts) in enumerate(slices(batches, BLOCK_BYTES)):
        block = f"{task}-{number}"
        terms, bounds, names = numbered(words_of(t or b"") for t in texts)
        n_words = np.diff(bounds)
        starts = bounds[:-1] + np.arange(len(texts))  # a gap after each document
        places = np.arange(len(terms)) + np.repeat(np.arange(len(texts)), n_words)
        order = np.argsort(terms, kind="stable")
        places = places[order]
        cuts = np.flatnonzero(np.diff(terms[order], prepend=-1))
        steps = np.diff(places, prepend=0)
        steps[cuts] = places[cuts]
        ends = np.append(cuts, len(terms))
        digests = [None if t is None else hashlib.md5(t).digest() for t in texts]
        head = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts), pa.array(n_words), pa.array(digests, pa.binary())], ["doc_id", "start", "n", "digest"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, head.schema) as writer:
            writer.write_batch(head)
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([None], pa.binary()), pa.array([len(ids)]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], INDEX_NAMES)
        lists = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(steps.astype("<u4"))])
        yield pa.RecordBatch.from_arrays([pa.repeat(block, len(names)), pa.array(names, pa.binary()), pa.array(np.diff(ends)), lists], INDEX_NAMES)


def build_index(docs: DataFrame) -> DataFrame:
    """Store the index of ``docs`` with the lists of all terms, so that it serves any benchmark. The rows with a null term
    hold each block's document directory."""
    small_batches(docs.sparkSession)
    return stored(id_text(docs).mapInArrow(posting_rows, INDEX), "postings")


@dataclass
class Windows:
    """The distinct windows of a chunk of the benchmark: terms, lengths, and the items that have each."""

    terms: list[tuple[bytes, ...]]
    items: list[list[str]]

    @classmethod
    def of(cls, rows: Iterable[tuple], width: int) -> Windows:
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in rows:
            words = words_of((text or "").encode())
            for i in range(max(1, len(words) - width + 1) if words else 0):
                found.setdefault(tuple(words[i : i + width]), set()).add(str(item))
        return cls(list(found), [sorted(x) for x in found.values()])


def plan_windows(windows: Windows, counts: dict[bytes, int]) -> tuple:
    """Term numbers and, per window, its (term, offset) pairs from the rarest on; windows with an absent term go."""
    numbers = {w: i for i, w in enumerate(sorted({w for t in windows.terms for w in t}))}
    ranked, lengths, items = [], [], []
    for terms, its in zip(windows.terms, windows.items, strict=True):
        if all(counts.get(w) for w in terms):
            ranked.append(sorted(((counts[w], o, numbers[w]) for o, w in enumerate(terms))))
            lengths.append(len(terms))
            items.append(its)
    width = max(lengths, default=0)
    term = np.full((len(ranked), width), -1, np.int64)
    offset = np.zeros((len(ranked), width), np.int64)
    for i, r in enumerate(ranked):
        term[i, : len(r)] = [x[2] for x in r]
        offset[i, : len(r)] = [x[1] for x in r]
    return numbers, term, offset, np.array(lengths, np.int64), items


def matches(keys: np.ndarray, first: np.ndarray, n: np.ndarray, term: np.ndarray, offset: np.ndarray, slop: int, starts: np.ndarray, n_words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start, document) of each match in one block. keys: sorted term << 32 | position; first, n: each term's list in it;
    starts, n_words: each document's positions. With ``slop`` a match begins at a word of a document, and each term is within ``slop``
    places of its own in that document, the rarest one too: each of its places gives 2 * slop + 1 starts."""
    alive = np.flatnonzero((n[term] > 0).all(axis=1, where=term >= 0)) if len(term) else np.zeros(0, np.int64)
    sizes = n[term[alive, 0]] if len(alive) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(alive):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), STEP // (2 * slop + 1), side="right")) + lo)
        w = np.repeat(alive[lo:hi], sizes[lo:hi])
        k = np.arange(len(w)) - np.repeat(np.cumsum(sizes[lo:hi]) - sizes[lo:hi], sizes[lo:hi])
        anchor = keys[first[term[w, 0]] + k] & 0xFFFFFFFF
        start, doc = anchor - offset[w, 0], np.searchsorted(starts, anchor, side="right") - 1
        if slop:
            w, doc = np.repeat(w, 2 * slop + 1), np.repeat(doc, 2 * slop + 1)
            start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
        ok = (start >= starts[doc]) & (start < starts[doc] + n_words[doc])
        w, start, doc = w[ok], start[ok], doc[ok]
        for c in range(1, term.shape[1]):
            t = term[w, c]
            at = start + offset[w, c]
            left = np.searchsorted(keys, (t << 32) | (np.maximum(at - slop, starts[doc]) if slop else at))
            right = np.searchsorted(keys, (t << 32) | np.minimum(at + slop, starts[doc] + n_words[doc] - 1), side="right") if slop else None
            found = (right > left) if slop else (keys[np.minimum(left, len(keys) - 1)] == ((t << 32) | at))
            ok = (t < 0) | found
            w, start, doc = w[ok], start[ok], doc[ok]
        yield w, start, doc
        lo = hi


def block_hits(plan, slop: int):
    """A mapper over the rows of one block to one row per document: covered words and the items found."""

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        numbers, term, offset, lengths, items = plan.value
        head = pdf[pdf.term.isna()].iloc[0]
        directory = pa.ipc.open_stream(head.positions).read_all()
        starts, n_words = directory["start"].to_numpy(), directory["n"].to_numpy()
        lists = [(numbers[t], p) for t, p in zip(pdf.term, pdf.positions, strict=True) if t is not None and t in numbers]
        lists.sort(key=lambda x: x[0])
        n = np.zeros(len(numbers) + 1, np.int64)
        first = np.zeros(len(numbers) + 1, np.int64)
        parts, at = [], 0
        for t, p in lists:
            x = np.cumsum(np.frombuffer(p, np.uint32).astype(np.int64))
            parts.append((t << 32) | x)
            first[t], n[t] = at, len(x)
            at += len(x)
        size = int(starts[-1] + n_words[-1] + 1) if len(starts) else 1
        edge = np.zeros(size + 1, np.int64)
        pairs = [np.zeros(0, np.int64)]
        if parts:
            for w, start, doc in matches(np.concatenate(parts), first, n, term, offset, slop, starts, n_words):
                np.add.at(edge, start, 1)
                np.add.at(edge, np.minimum(start + lengths[w], starts[doc] + n_words[doc]), -1)
                pairs.append(np.unique(doc * len(lengths) + w))
        covered = (np.cumsum(edge[:-1]) > 0).astype(np.int8)
        found = np.unique(np.concatenate(pairs))
        names: dict[int, set[str]] = {}
        for d, w in zip((found // max(1, len(lengths))).tolist(), (found % max(1, len(lengths))).tolist(), strict=True):
            names.setdefault(d, set()).update(items[w])
        hits, sets, n_hit = [None] * len(starts), [[] for _ in starts], np.zeros(len(starts), np.int64)
        for d, its in names.items():
            own = covered[starts[d] : starts[d] + n_words[d]]
            n_hit[d] = own.sum()
            hits[d] = np.flatnonzero(np.diff(own, prepend=0, append=0)).astype(np.uint32).tobytes()
            sets[d] = sorted(its)
        ids = directory["doc_id"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        return pd.DataFrame({"block": head.block, "place": np.arange(len(starts)), "doc_id": ids, "digest": directory["digest"].to_pylist(), "n_words": n_words, "n_hit": n_hit, "hits": hits, "items": sets})

    return evaluate


def phrase_hits(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """One row per document of the index: RESULT, where ``hits`` holds the borders of runs of covered words."""
    spark = index.sparkSession
    wanted = {w for t in windows.terms for w in t}
    terms = spark.createDataFrame([(bytearray(w),) for w in wanted], "term binary")
    counted = index.where("term IS NOT NULL").join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {bytes(r.term): r.n for r in counted.collect()}  # at most one row per term of the bounded chunk
    plan = spark.sparkContext.broadcast(plan_windows(windows, counts))
    rows = index.where("term IS NULL").unionByName(index.where("term IS NOT NULL").join(F.broadcast(terms), "term", "left_semi").select(*INDEX_NAMES))
    return rows.groupBy("block").applyInPandas(block_hits(plan, slop), RESULT)


def benchmark_chunks(benchmark: DataFrame, width: int, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Windows]:
    """The benchmark's windows, in chunks of at most about ``chunk_bytes`` of text; the driver holds one chunk and one item
    at a time. Equal rows count once; an item longer than a chunk is cut, the parts overlapping by a window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    rows: list[tuple] = []
    size = 0
    for r in items.toLocalIterator():
        words = words_of((r.text or "").encode())
        most = max(width, chunk_bytes // 16)
        for at in range(0, max(1, len(words) - width + 1), most):
            part = b" ".join(words[at : at + most + width - 1]).decode()
            rows.append((r.item_id, part))
            size += len(part)
            if size >= chunk_bytes:
                yield Windows.of(rows, width)
                rows, size = [], 0
    if rows or not size:
        yield Windows.of(rows, width)


def merge_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one document from several chunks of the benchmark to one: covered words and items are united."""
    n = int(pdf.n_words.iloc[0])
    edge = np.zeros(n + 1, np.int64)
    items: set[str] = set()
    for h, its in zip(pdf.hits, pdf["items"], strict=True):
        if h is not None:
            b = np.frombuffer(h, np.uint32).astype(np.int64)
            np.add.at(edge, b[::2], 1)
            np.add.at(edge, b[1::2], -1)
            items.update(its)
    covered = (np.cumsum(edge[:-1]) > 0).astype(np.int8)
    merged = np.flatnonzero(np.diff(covered, prepend=0, append=0)).astype(np.uint32).tobytes()
    return pdf.iloc[:1].assign(n_hit=[int(covered.sum())], hits=[merged if items else None], items=[sorted(items)])


def judged(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of ``docs``: the columns of ``contamination`` and the MD5 digest of the text that they were found in."""
    index = build_index(docs)
    parts = [stored(phrase_hits(index, windows, slop), "hits") for windows in benchmark_chunks(benchmark, width, chunk_bytes)]
    found = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy("block", "place").applyInPandas(merge_chunks, RESULT)
    return found.select("doc_id", "digest", "n_words", "n_hit", "items").withColumn("contaminated", F.col("n_hit") > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside matched windows), items (sorted ids), contaminated."""
    return judged(docs, benchmark, width, slop, chunk_bytes).drop("digest")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents without a benchmark passage, all columns as they are. Each row is judged by its own text, whatever
    other rows share its doc_id or have a null one too."""
    bad = judged(docs, benchmark, width).where("contaminated").select(F.col("doc_id").alias("__bad"), F.col("digest").alias("__digest")).distinct()
    digest = F.unhex(F.md5(docs["text"].cast("string").cast("binary")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__bad"]) & (digest == bad["__digest"]), "left_anti")
