"""Tables in hash buckets of one key: a write replaces whole buckets and leaves the others where they are.

A version is a folder ``v-N`` with a folder for each bucket that it replaced; the state of a bucket is the latest version whose
job was committed, so that readers see whole buckets and a failed job changes nothing. A replaced bucket always holds a marker
row, by which an empty bucket is known. A version that no bucket's state or the state before needs goes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import first_of_each

FOLDER = re.compile(r"/(v-\d{8})/bucket=(\d+)-(\d+)$")


class BucketedTable:
    """The table at ``path`` with ``number`` buckets of the column or expression ``key`` over its columns.

    Defined results: a null key is a bucket's key like others; rows are kept as often as they come; a table never written is
    empty; columns that the schema doesn't name are left out, missing ones are null; with another ``number`` the table is empty
    until it is written anew. One writer at a time. The driver holds numbers of buckets only.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | Column, number: int = 64) -> None:
        self.spark, self.path, self.number = spark, path.rstrip("/"), number
        self.key = F.col(key) if isinstance(key, str) else key
        self.schema = spark.createDataFrame([], schema).schema

    def _files(self, pattern: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return system, [s.getPath() for s in system.globStatus(path) or []]

    def versions(self) -> list[str]:
        """The committed versions, the latest last."""
        return sorted(p.getParent().getName() for p in self._files("v-*/_SUCCESS")[1])

    def state(self) -> dict[int, tuple[str, str]]:
        """The version and folder of each bucket that was ever written."""
        committed = set(self.versions())
        found: dict[int, tuple[str, str]] = {}
        for path in sorted(p.toString() for p in self._files(f"v-*/bucket={self.number}-*")[1]):
            version, _, bucket = FOLDER.search(path).groups()
            if version in committed:
                found[int(bucket)] = (version, path)
        return found

    def bucket(self, key: Column | None = None) -> Column:
        """The bucket of a row, or of the value of a key."""
        return F.pmod(F.xxhash64(self.key if key is None else key), F.lit(self.number)).cast("int")

    def touched(self, rows: DataFrame, key: Column | None = None) -> list[int]:
        """The buckets of the rows, by their key or by ``key``: at most ``number`` values."""
        return sorted(r.bucket for r in rows.select(self.bucket(key).alias("bucket")).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some: only their folders are listed and read."""
        state = self.state()
        paths = [state[b][1] for b in (sorted(state) if buckets is None else buckets) if b in state]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        schema = self.spark.createDataFrame([], self.schema).withColumn("__marker", F.lit(True)).schema
        return self.spark.read.schema(schema).parquet(*paths).where("__marker IS NULL").select(*self.schema.names)

    def replace(self, rows: DataFrame, buckets: list[int] | None = None) -> None:
        """Put ``rows`` in the place of the given buckets, all by default; the rows have to belong to them. A bucket of many rows is written by
        several tasks."""
        buckets = list(range(self.number)) if buckets is None else buckets
        if not buckets:
            return
        versions, before = self.versions(), self.state()
        version = f"v-{int(versions[-1][2:]) + 1 if versions else 1:08d}"
        known = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        kept = rows.select(*known).withColumn("__marker", F.lit(None).cast("boolean")).withColumn("__bucket", self.bucket())
        markers = self.spark.createDataFrame([(b,) for b in buckets], "__bucket int").withColumn("__marker", F.lit(True))
        named = kept.unionByName(markers, allowMissingColumns=True).withColumn("bucket", F.concat(F.lit(f"{self.number}-"), "__bucket")).drop("__bucket")
        named.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{version}")  # what a failed job left goes
        self._clear({v for v, _ in before.values()} | {v for v, _ in self.state().values()}, versions)

    def _clear(self, needed: set[str], versions: list[str]) -> None:
        """Delete the versions that neither the present state nor the one before needs."""
        system, folders = self._files("v-*")
        for folder in folders:
            if folder.getName() in versions and folder.getName() not in needed:
                system.delete(folder, True)

    def exchange(self, rows: DataFrame, gone: DataFrame, on: str, buckets: list[int]) -> None:
        """In the given buckets, replace the rows whose ``on`` is in ``gone`` by ``rows``."""
        old = self.read(buckets).join(gone.select(on).distinct(), on, "left_anti")
        self.replace(old.unionByName(rows, allowMissingColumns=True), buckets)

    def upsert(self, rows: DataFrame, keys: list[str], version: str) -> None:
        """Add rows; of each ``keys``, which have to hold the table's key, the latest ``version`` stays."""
        buckets = self.touched(rows)
        both = self.read(buckets).unionByName(rows, allowMissingColumns=True)
        self.replace(first_of_each(both, keys, [F.desc(version)]), buckets)


def together(buckets: list[list[int]]) -> list[int]:
    """All of several lists of buckets."""
    return sorted(set().union(*buckets))
