"""Helpers that the operators share: stored intermediate tables, Arrow batches, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that one slice of a batch holds at most (a single longer text is a slice of its own).
SLICE_BYTES = 4 << 20
#: Rows of one Arrow batch.
BATCH_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where driver and executors are one process
    (tests) may it be unset; a local folder is taken then."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "zstd", partition_by: str | None = None, row_group: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (``row_group``: bytes of a row group) and read it back: lineage ends
    here, and a lost executor costs only its running tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if row_group:
        writer = writer.option("parquet.block.size", str(row_group))
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings to a Python worker; long texts make 10,000 rows too many. Plans read the settings
    when they run, so they stay; smaller ones of the caller's are kept."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def decoded(text: bytes | None) -> str:
    """The characters of a text; null is empty, and bytes that are no UTF-8 become replacement characters."""
    return (text or b"").decode("utf-8", "replace")


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[bytes | None]]]:
    """(ids, UTF-8 texts or None) of batches with the columns (id, text), in slices of about ``limit`` bytes."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t or b"")
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
    release_memory()


def release_memory() -> None:
    """Give freed memory back to the system: workers stay alive for later stages, beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def numbered(word_lists: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Each word's number in the slice's vocabulary, the bounds of each list, the vocabulary."""
    vocab: dict[bytes, int] = NumberedWords()
    parts, bounds = [], [0]
    for words in word_lists:
        parts.append(np.fromiter(map(vocab.__getitem__, words), np.int64, len(words)))
        bounds.append(bounds[-1] + len(words))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(bounds, np.int64), list(vocab)


class NumberedWords(dict):
    """A dictionary that gives each new key the next number."""

    def __init__(self) -> None:
        super().__init__()
        self._next = count().__next__

    def __missing__(self, key: bytes) -> int:
        self[key] = n = self._next()
        return n


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers that follow from the seed."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) | np.uint64(1)


def window_hashes(values: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive values (unsigned 64-bit)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, c in enumerate(odd_constants(width, seed)):
        total += values[k : k + n] * c
    return mix64(total)


def folds(doc_id, k: int):
    """crc32 of the id as text, modulo k, as a column."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def fold(doc_id: int, k: int) -> int:
    """The same for one id."""
    return zlib.crc32(str(doc_id).encode()) % k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that most operators need, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bounded_sample(rows: DataFrame, number: int, group: str, keys: tuple[str, ...] = ("doc_id",), seed: int = 0) -> DataFrame:
    """At most ``number`` distinct rows (keys, group) of each value of ``group`` (of which there are few), those with the
    least hashes of ``keys``.

    The groups' sizes give each a bound on the hash that about four times as many rows pass; only these are made
    distinct and ranked, so what meets in a group's task does not grow with the table.
    """
    sizes = rows.groupBy(F.col(group).alias("__g")).agg(F.approx_count_distinct(F.xxhash64(*keys), 0.02).alias("__n"))
    place = F.xxhash64(*keys, F.lit(seed)).bitwiseAND(F.lit(2**63 - 1)) / F.lit(float(2**63))
    hashed = rows.select(*keys, group).withColumn("__u", place).join(F.broadcast(sizes), F.col(group) == F.col("__g"))
    few = hashed.where(F.col("__u") * F.col("__n") <= 4 * number).select(*keys, group, "__u").distinct()
    rank = F.row_number().over(Window.partitionBy(group).orderBy("__u", *keys))
    return few.withColumn("__r", rank).where(F.col("__r") <= number).drop("__u", "__r")


def text_digest(text: str = "text"):
    """A 64-bit hash of a text, by which rows that share a doc_id are told apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
