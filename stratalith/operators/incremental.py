"""Incremental builds: what changed, upserts, replacement with children, cached results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import first_of_each
from .storage import dealt


def changes(scanned: DataFrame, cached: DataFrame, key: str, state: list[str]) -> DataFrame:
    """(key, change) of all keys: ``new``, ``changed``, ``same`` or ``gone``, by the state columns."""
    side = lambda df, p: df.select(F.col(key), F.struct(*state).alias(p))
    joined = side(scanned, "now").join(side(cached, "was"), key, "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now").eqNullSafe(F.col("was")), "same").otherwise("changed")
    return joined.select(key, change.alias("change"))


def unchanged_skipped(scanned: DataFrame, cached: DataFrame, key: str, state: list[str]) -> DataFrame:
    """The scanned rows to work on: those without an equal row in the cache."""
    return scanned.join(cached.select(key, *state).distinct(), [key, *state], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str, ties: list[str] = ()) -> DataFrame:
    """Old and new rows, of each key the one with the latest version."""
    return first_of_each(old.unionByName(new, allowMissingColumns=True), keys, [F.desc(version), *map(F.desc, ties)])


def replaced(parents: DataFrame, children: DataFrame, new_parents: DataFrame, new_children: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children after the parents of ``new_parents`` and all their children were replaced; both are dealt by the key."""
    gone = dealt(new_parents.select(key), key).distinct()
    kept = lambda rows: dealt(rows, key).join(gone, key, "left_anti")
    return dealt(kept(parents).unionByName(new_parents), key), dealt(kept(children).unionByName(new_children), key)


def valid(row_hash: Column, cached_hash: Column, corrected: Column) -> Column:
    """Whether a cached analysis still holds."""
    return corrected | row_hash.eqNullSafe(cached_hash)


def get_or_create(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows plus those wanted that aren't there."""
    return rows.unionByName(wanted.join(rows.select(key), key, "left_anti").dropDuplicates([key]), allowMissingColumns=True)
