"""A write-once table of answers by the digest of their prompt.

``Answers.ensure`` asks for what is missing and returns when all is written, so that plans only ever read answers. Prompts
are dealt to ``BUCKETS`` by their digest; a bucket's task writes each answered batch as a file of its own at once, and reads what its
bucket holds before it asks: a task that is repeated after a lost executor goes on where the lost one stopped. At most the
batch that was under way is asked again.

Defined results: equal prompts are one; a null prompt has no answer; a batch that fails, or that answers with another number of texts,
leaves no rows and is asked again by the next call; answers never change.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import storage
from ..sources import tree

Completer = Callable[[list[str]], list[str]]

BUCKETS, BATCH = 64, 50
#: Missing digests (some 100 bytes each) so few are broadcast, so that only their prompts are moved.
BROADCAST_DIGESTS = 100_000
SCHEMA = "digest string, answer string"


def digest_of(prompt: Column) -> Column:
    return F.sha2(prompt.cast("binary"), 256)


def written(root: str, bucket: int) -> set[str]:
    """The digests that a bucket holds."""
    place = tree.store(root)
    folder = f"bucket={bucket}"
    try:
        names = [e.name for e in place.entries(folder) if e.name.endswith(".parquet")]
    except OSError:
        return set()
    return {d for n in names for d in pq.read_table(pa.BufferReader(place.content(f"{folder}/{n}")), columns=["digest"])["digest"].to_pylist()}


def put(root: str, bucket: int, rows: dict[str, str]) -> None:
    """Write a batch as one file, named by what it holds; it appears whole or not at all."""
    buffer = pa.BufferOutputStream()
    pq.write_table(pa.table({"digest": list(rows), "answer": list(rows.values())}, pa.schema([("digest", pa.string()), ("answer", pa.string())])), buffer)
    name = hashlib.sha256("".join(sorted(rows)).encode()).hexdigest()[:32]
    place = tree.store(root)
    final, early = (place.place(f"bucket={bucket}/{x}") for x in (f"{name}.parquet", f"_{name}-{os.getpid()}"))
    if urlparse(root).scheme in ("", "file"):
        os.makedirs(os.path.dirname(final), exist_ok=True)
        with open(early, "wb") as f:
            f.write(buffer.getvalue())
        os.replace(early, final)
    else:
        place.system.create_dir(final.rpartition("/")[0])
        with place.system.open_output_stream(early) as f:
            f.write(buffer.getvalue())
        place.system.move(early, final)


def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (digest, prompt) of a task with each digest once, so that a frequent prompt is moved once a task."""
    seen: set[str] = set()
    for batch in batches:
        new = []
        for d in batch.column(0).to_pylist():
            new.append(d not in seen)
            seen.add(d)
        yield batch.filter(pa.array(new, pa.bool_()))


def asked(root: str, completer: Completer, size: int):
    """The mapper of sorted (bucket, digest, prompt) to (bucket, asked, failed): numbers of prompts of each batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known, todo = None, set(), {}

        def batch() -> pa.RecordBatch:
            prompts = list(todo.values())
            try:
                answers = completer(prompts)
                good = len(answers) == len(prompts)
            except Exception:
                good = False
            if good:
                put(root, bucket, dict(zip(todo, answers, strict=True)))
            counts = [[bucket], [len(prompts)], [0 if good else len(prompts)]]
            todo.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in counts], ["bucket", "asked", "failed"])

        for rows in batches:
            for b, digest, prompt in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if b != bucket:
                    if todo:
                        yield batch()
                    bucket, known = b, written(root, b)
                if digest not in known:
                    known.add(digest)
                    todo[digest] = prompt
                if len(todo) >= size:
                    yield batch()
        if todo:
            yield batch()

    return run


class Answers:
    """The answers under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def read(self) -> DataFrame:
        """(digest, answer) of all prompts that were answered; two tasks that ran at once may both have asked, one answer stays."""
        empty = self.spark.createDataFrame([], SCHEMA)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/bucket=*/*.parquet")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place):
            return empty
        rows = self.spark.read.schema("digest string, answer string, bucket int").parquet(self.root)
        return rows.groupBy("digest").agg(F.min("answer").alias("answer"))

    def ensure(self, prompts: DataFrame, completer: Completer, size: int = BATCH) -> dict[str, int]:
        """Ask for each distinct ``prompt`` that has no answer; the numbers of prompts asked and failed."""
        named = prompts.where("prompt IS NOT NULL").select(digest_of(F.col("prompt")).alias("digest"), "prompt")
        known = self.read().select("digest")
        missing = storage.stored(named.select("digest").distinct().join(known, "digest", "left_anti"), "missing")
        number = missing.count()
        if not number:
            return {"asked": 0, "failed": 0}  # no prompt was moved
        if number <= BROADCAST_DIGESTS:  # else tasks leave out what their buckets hold
            named = named.join(F.broadcast(missing), "digest", "left_semi")
        bucket = F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).cast("bigint")
        own = named.mapInArrow(once, "digest string, prompt string")
        rows = own.select(bucket.alias("bucket"), "digest", "prompt").repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "digest")
        told = rows.mapInArrow(asked(self.root, completer, size), "bucket bigint, asked bigint, failed bigint").agg(F.sum("asked").alias("asked"), F.sum("failed").alias("failed")).first()
        return {"asked": told["asked"] or 0, "failed": told["failed"] or 0}

    def told(self, rows: DataFrame, prompt: str, completer: Completer) -> DataFrame:
        """Rows with ``answer``: from the table, which is filled first; empty where asking failed or there is no prompt."""
        self.ensure(rows.select(F.col(prompt).alias("prompt")), completer)
        known = self.read().select(F.col("digest").alias("__digest"), F.col("answer").alias("__answer"))
        named = rows.withColumn("__asked", digest_of(F.col(prompt)))  # by itself, so that prompts nobody reads aren't moved
        return named.join(known, F.col("__asked") == F.col("__digest"), "left").select(*rows.columns, F.coalesce("__answer", F.lit("")).alias("answer"))
