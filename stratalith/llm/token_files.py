"""Operator 4, token files: ids of all documents in ascending doc_id order, in a canonical Huffman code.

1. Documents are dealt by ranges of doc_id, sorted and encoded to ids once; ids and counts are kept.
2. The global counts (one per id of the vocabulary) give code lengths of at most ``MAX_BITS`` by package-merge; the
   canonical code follows from the lengths alone.
3. Each run of documents becomes a block row of the file: block number, the code lengths' digest, doc ids and their
   numbers of ids, the bit string, and a checkpoint every ``STRIDE`` ids: the bit offset where decoding can start.
   Blocks decode independently, and within a block all checkpoints decode side by side with one table lookup an id.

File format: Parquet files written by Spark (atomic, any file system), rows ordered by (part, block); a row holds
``part, block, doc_ids, lengths (uint32), n_ids, checkpoints (uint32), payload`` and the table ``codebook`` beside them
holds ``id, bits`` for every id that occurs.

Defined results: a null text is an empty one (its end id alone); rows with equal ids are ordered by their ids' crc32,
null ids come first; an empty table gives an empty file; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import decoded, id_text, release_memory, shared_dir, slices, small_batches
from .tokens import encoder

END_ID = 0
MAX_BITS = 20
#: Ids between two checkpoints, and ids of a block at least (a longer document makes a longer block).
STRIDE, BLOCK_IDS = 64, 1 << 19

RAW = "part int, place long, doc_id long, ids binary"
BLOCKS = "part int, block long, doc_ids array<long>, lengths binary, n_ids long, checkpoints binary, payload binary"
DECODED = "part int, block long, place long, doc_id long, n_tokens long, before long, ids_crc32 long, n_ids long"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the ids with a count (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit into {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64 if counts.sum() > 2**62 else np.int64)
    n = len(order)
    level, leaf_of = leaves, [np.arange(n)]  # per level: the leaf, or -1 for a package of two of the level before
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        leaf_of.append(np.where(rank < n, rank, -1))
    take, out = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(leaf_of):
        chosen = leaf[:take]
        out[chosen[chosen >= 0]] += 1
        take = 2 * int((chosen < 0).sum())
    lengths[order] = out
    return lengths


@dataclass
class Code:
    """A canonical code: bits and code word of each id, and the decoding table over ``width`` bits."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        self.words = np.zeros(len(self.lengths), np.uint64)
        word, last = 0, 0
        for i, n in zip(order.tolist(), self.lengths[order].tolist(), strict=True):
            word <<= n - last
            self.words[i] = word
            word, last = word + 1, n
        self.width = int(self.lengths.max(initial=1))
        span = 1 << (self.width - self.lengths[order])
        self.table_id = np.zeros(1 << self.width, np.uint32)
        self.table_bits = np.ones(1 << self.width, np.uint8)
        self.table_id[: span.sum()] = np.repeat(order, span)
        self.table_bits[: span.sum()] = np.repeat(self.lengths[order], span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bit string and the bit offset of every ``STRIDE``-th id."""
        n = self.lengths[ids].astype(np.uint64)
        at = np.concatenate([np.zeros(1, np.uint64), np.cumsum(n, dtype=np.uint64)])
        word = (at[:-1] >> np.uint64(6)).astype(np.int64)
        inside = at[:-1] & np.uint64(63)
        over = np.maximum(inside + n, 64) - 64  # bits that reach into the next 64
        codes = self.words[ids]
        high = np.where(over > 0, codes >> over, codes << (np.uint64(64) - np.minimum(inside + n, np.uint64(64))))
        out = np.zeros(int(at[-1] >> np.uint64(6)) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        if len(ids):
            out[word[first]] = np.bitwise_or.reduceat(high, first)
        spill = np.flatnonzero(over)
        out[word[spill] + 1] |= codes[spill] << (np.uint64(64) - over[spill])
        size = (int(at[-1]) + 7) // 8
        return out.astype(">u8").tobytes()[:size], at[:-1:STRIDE].astype("<u8").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n_ids: int) -> np.ndarray:
        """The ids: all checkpoints advance together, one table lookup an id."""
        data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        four = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        out = np.zeros((STRIDE, len(at)), np.uint32)
        shift = 32 - self.width
        for k in range(STRIDE):
            byte = np.minimum(at >> 3, len(four) - 1)
            peek = (four[byte] << (at & 7).astype(np.uint32)) >> np.uint32(shift)
            out[k] = self.table_id[peek]
            at = at + self.table_bits[peek]
        return out.T.reshape(-1)[:n_ids]


def raw_rows(path: str, end_id: int, marks_as_text: bool = True):
    """A mapper from sorted (doc_id, text) to their ids, numbered within the partition."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, code, place = TaskContext.get().partitionId(), encoder(path, marks_as_text), 0
        kind = "<u2" if code.n <= 1 << 16 else "<u4"
        tail = np.array([end_id], kind).tobytes()
        for ids, texts in slices(batches):
            tokens, at = code.ids([decoded(t) for t in texts])
            data, step = tokens.astype(kind).tobytes(), np.dtype(kind).itemsize
            cuts = (at * step).tolist()
            rows = [data[a:b] + tail for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names(RAW))
            place += n
        code.forget()
        release_memory()

    return build


def count_rows(vocabulary: int):
    """A mapper from raw rows to (id, n), one row per id and task."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, total = "<u2" if vocabulary <= 1 << 16 else "<u4", np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return build


def block_rows(shared, vocabulary: int):
    """A mapper from raw rows in order to blocks. A block's number is the place of its first document."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, kind = shared.value, "<u2" if vocabulary <= 1 << 16 else "<u4"
        rows: list[tuple] = []

        def block() -> pa.RecordBatch:
            part, place = rows[0][:2]
            ids = np.frombuffer(b"".join(r[3] for r in rows), kind)
            payload, checkpoints = code.encode(ids)
            lengths = np.array([len(r[3]) // np.dtype(kind).itemsize for r in rows], "<u4").tobytes()
            columns = [[part], [place], [[r[2] for r in rows]], [lengths], [len(ids)], [checkpoints], [payload]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names(BLOCKS))

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if rows and (row[0] != rows[0][0] or row[1] != rows[-1][1] + 1 or size >= BLOCK_IDS * 2):
                    yield block()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield block()

    return build


def decoded_rows(shared):
    """A mapper from blocks to one row per document, from its decoded ids."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                ids = code.decode(r["payload"], r["checkpoints"], r["n_ids"]).astype("<u4").tobytes()
                n = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                k = len(n)
                arrays = [pa.array(np.full(k, r["part"], np.int32)), pa.array(np.full(k, r["block"])), pa.array(np.arange(k))]
                arrays += [pa.array(r["doc_ids"], pa.int64()), pa.array(n), pa.array(ends - n), pa.array(crc, pa.int64()), pa.array(np.full(k, r["n_ids"]))]
                yield pa.RecordBatch.from_arrays(arrays, names(DECODED))

    return build


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, max_bits: int = MAX_BITS, marks_as_text: bool = True) -> None:
    """Write the blocks to ``path``/blocks and the code lengths to ``path``/codebook. ``marks_as_text`` is the encoder's."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = encoder(tokenizer_path, marks_as_text).n
    raw_path = f"{path}/raw"
    ordered = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    ordered.mapInArrow(raw_rows(tokenizer_path, end_id, marks_as_text), RAW).write.option("compression", "zstd").parquet(raw_path)
    raw = spark.read.schema(RAW).parquet(raw_path)
    counted = raw.select("ids").mapInArrow(count_rows(vocabulary), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for r in counted.collect():  # at most one row per id of the vocabulary
        counts[r.id] = r.n
    lengths = code_lengths(counts, max_bits)
    used = np.flatnonzero(lengths)
    book = pa.table({"id": used, "bits": lengths[used]})
    spark.createDataFrame(book.to_pandas(), "id long, bits long").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(Code(lengths))
    raw.mapInArrow(block_rows(shared, vocabulary), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    remove(spark, raw_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_code(spark: SparkSession, path: str) -> Code:
    """The code of a written file, from its codebook (bounded by the vocabulary)."""
    rows = spark.read.schema("id long, bits long").parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        lengths[r.id] = r.bits
    return Code(lengths)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: doc_id, start, n_tokens, ids_crc32 of every document, in the order that was written."""
    shared = spark.sparkContext.broadcast(read_code(spark, path))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "block", (F.col("part_start") + F.col("inside")).alias("block_start"))
    rows = blocks.mapInArrow(decoded_rows(shared), DECODED).join(starts, ["part", "block"])
    return rows.select("doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, marks_as_text: bool = True) -> DataFrame:
    """Write, then read back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer_path, path, marks_as_text=marks_as_text)
    return read_token_files(spark, path)
