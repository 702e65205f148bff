"""Filters, joins, aggregates, orders and windows of the knowledge base, over any tables.

Every function returns a lazy plan. Counts per parent are aggregated before they are joined; small sides are left to the
optimizer to broadcast by their size; top-k goes through one bounded sort; ranks within a key carry a limit that Spark
applies before the shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .storage import dealt, globally_ranked, stored


def contains_word(column: str, word: str | None) -> Column:
    """Case-insensitive LIKE with the word anywhere; ``%`` and ``_`` in it are wildcards. No word, no condition."""
    return F.lit(True) if not word else F.ilike(column, F.lit("%" + word.replace("\\", "\\\\") + "%"))


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given."""
    return reduce(Column.__and__, [c for c in conditions if c is not None], F.lit(True))


def shortest_matches(rows: DataFrame, column: str, word: str, ties: list[str], number: int = 20) -> DataFrame:
    """Rows whose column contains the word, the shortest values first."""
    return rows.where(contains_word(column, word)).orderBy(F.length(column), column, *ties).limit(number)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of the ordered rows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    """total and pages."""
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.floor((F.col("total") + size - 1) / size).cast("bigint"))


def with_count(parents: DataFrame, key: str, children: DataFrame, foreign: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 if none."""
    counted = children.groupBy(F.col(foreign).alias("__key")).agg(F.count("*").alias(name))
    joined = parents.join(counted, F.col(key) == F.col("__key"), "left").drop("__key")
    return joined.withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column], number: int = 1) -> DataFrame:
    """The first ``number`` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= number).drop("__rank")


def tagged_union(parts: dict[str, DataFrame], tag: str = "kind") -> DataFrame:
    """The parts one after another, each row with its part's name."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


#: Rows of either side in a cell of the product of a key's rows.
CELL = 1024


def crossed(left: DataFrame, right: DataFrame, key: str, left_place: list[str], right_place: list[str]) -> DataFrame:
    """The join of both by ``key`` where few rows make many: a key's rows meet in cells of about ``CELL`` of either side, dealt to all
    partitions. ``left_place`` and ``right_place`` are columns that tell a side's rows apart."""
    number = lambda rows, name: rows.groupBy(key).agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))
    cells = stored(number(left, "__rows").join(number(right, "__columns"), key), "cells")
    place = lambda columns, most: F.pmod(F.xxhash64(*columns), F.col(most)).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))
    ways = [key, "__row", "__column"]
    left = left.join(cells, key).withColumn("__row", place(left_place, "__rows")).withColumn("__column", every("__columns")).drop("__rows", "__columns")
    right = right.join(cells, key).withColumn("__column", place(right_place, "__columns")).withColumn("__row", every("__rows")).drop("__rows", "__columns")
    return dealt(left, *ways).join(dealt(right, *ways), ways).drop("__row", "__column")


def top_fraction(rows: DataFrame, order: list[Column], share: float = 0.6, least: int = 5) -> DataFrame:
    """The first ``share`` of the rows, ``least`` at least; the rank is distributed, as the share may be large."""
    ranked = globally_ranked(rows, order)
    total = ranked.agg(F.count("*").alias("__total"))
    kept = ranked.join(F.broadcast(total), F.col("rank") <= F.greatest(F.lit(least), F.floor(F.col("__total") * share)))  # one row
    return kept.drop("rank", "__total")


def not_selected(rows: DataFrame, forced: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't among the forced ones."""
    return rows.join(forced.select(*keys).distinct(), keys, "left_anti")


def group_changes(rows: DataFrame, key: str, partition: list[str], order: list[str]) -> DataFrame:
    """Rows with ``starts``: whether the key differs from the row before."""
    before = F.lag(key).over(Window.partitionBy(*partition).orderBy(*order))
    return rows.withColumn("starts", ~F.col(key).eqNullSafe(before))


def within_budget(rows: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int, number: int) -> DataFrame:
    """Per key the ranked rows up to the first that overflows the budget, ``number`` at most."""
    window = Window.partitionBy(*keys).orderBy(*order)
    spent = F.sum(cost).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.withColumn("rank", F.row_number().over(window).cast("bigint")).where(F.col("rank") <= number)
    return ranked.withColumn("spent", spent.cast("bigint")).where(F.col("spent") <= budget)


def score_gap(rows: DataFrame, keys: list[str], order: list[Column], score: str, ratio: float) -> DataFrame:
    """The first row of each key with ``clear``: whether its score beats the second's by the ratio. Only each task's first
    two rows of a key are shuffled."""
    window = Window.partitionBy(*keys).orderBy(*order)
    two = first_of_each(rows, keys, order, 2)
    ranked = two.withColumn("second", F.lead(score).over(window)).withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")
    return ranked.withColumn("clear", F.col("second").isNull() | (F.col(score) > ratio * F.col("second")))


def fixed_batches(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Rows of each key with ``batch``: runs of ``size`` in order. Ranks are distributed, so a key may have any number of
    rows."""
    ranked = globally_ranked(rows, [F.col(c) for c in [*keys, *order]])
    first = ranked.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("rank").alias("__first"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = ranked.join(first, same)
    return joined.select(*rows.columns, F.floor((F.col("rank") - F.col("__first")) / size).cast("bigint").alias("batch"))


#: Rows of a stretch of the total order that one task cuts into batches.
STRETCH = 50_000


def greedy_batches(rows: DataFrame, keys: list[str], order: list[str], cost: str, most: int, budget: int) -> DataFrame:
    """Rows (keys, order, cost) of each key with ``batch``: a batch ends before the row that would exceed the number or the
    budget. A key may have any number of rows.

    The rows of all keys stand in one total order, cut into stretches. Where a batch can end depends on where it began, but
    a stretch can only be entered at one of its first ``most`` rows: each stretch tells where each entrance leads (and how
    many batches begin on the way), a walk over these small tables finds every stretch's true entrance, and then the
    stretches are cut independently.
    """
    plain = rows.select(*keys, *order, F.col(cost).cast("bigint").alias("cost"))
    ranked = globally_ranked(plain, [F.col(c) for c in [*keys, *order, "cost"]])
    before = F.struct(*keys)
    first = ranked.groupBy(before.alias("__key")).agg(F.min("rank").alias("__first"))
    placed = ranked.join(first, before.eqNullSafe(F.col("__key"))).withColumn("__opens", F.col("rank") == F.col("__first")).drop("__key", "__first")
    placed = stored(placed.withColumn("__at", F.floor((F.col("rank") - 1) / STRETCH)), "placed")
    # The rows of the next stretch that a last batch can reach into.
    ahead = placed.where((F.col("rank") - 1) % STRETCH < most).withColumn("__at", F.col("__at") - 1)
    both = placed.withColumn("__own", F.lit(True)).unionByName(ahead.withColumn("__own", F.lit(False)))

    def ends(pdf: pd.DataFrame) -> np.ndarray:
        """For each row of a stretch and what is ahead the place after a batch that begins there."""
        n = len(pdf)
        total = np.concatenate([[0], np.cumsum(pdf["cost"].to_numpy(np.int64))])
        end = np.searchsorted(total, total[:-1] + budget, side="right") - 1
        opens = np.append(np.flatnonzero(pdf["__opens"].to_numpy(bool)), n)
        following = opens[np.searchsorted(opens, np.arange(n), side="right")]
        return np.minimum(np.minimum(np.maximum(end, np.arange(n) + 1), np.arange(n) + most), following)

    def doors(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        end, own = ends(pdf), int(pdf["__own"].sum())
        leads, number = np.arange(len(end) + 1), np.zeros(len(end) + 1, np.int64)
        for i in range(own - 1, -1, -1):
            leads[i], number[i] = leads[end[i]], number[end[i]] + 1
        enter = np.arange(min(most, own))
        return pd.DataFrame({"at": pdf["__at"].iloc[0], "enter": enter, "leave": leads[enter] - own, "number": number[enter]})

    table = both.groupBy("__at").applyInPandas(doors, "at long, enter long, leave long, number long")
    steps: dict[int, dict[int, tuple[int, int]]] = {}
    for r in table.collect():  # ``most`` rows for every STRETCH rows
        steps.setdefault(r["at"], {})[r["enter"]] = (r["leave"], r["number"])
    entrance, entered = 0, []
    for at in sorted(a for a in steps if a >= 0):
        entered.append((at, entrance))
        entrance = steps[at].get(entrance, (0, 0))[0]  # the last stretch may be used up by the batch before
    true = plain.sparkSession.createDataFrame(entered, "__at long, __enter long")
    schema = StructType([*plain.schema.fields, StructField("rank", LongType()), StructField("__starts", BooleanType())])

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        end, own = ends(pdf), int(pdf["__own"].sum())
        starts, i = np.zeros(len(end), bool), int(pdf["__enter"].iloc[0])
        while i < own:
            starts[i] = True
            i = end[i]
        return pdf.assign(__starts=starts)[pdf["__own"].to_numpy(bool)][schema.names]

    marked = both.join(F.broadcast(true), "__at").groupBy("__at").applyInPandas(cut, schema)  # a row for every stretch
    # Batches of a key are numbered by the starts before a row: those of its stretch and of all earlier ones.
    marked = stored(marked.withColumn("__at", F.floor((F.col("rank") - 1) / STRETCH)), "marked")
    inside = F.sum(F.col("__starts").cast("long")).over(Window.partitionBy("__at").orderBy("rank"))
    sums = marked.groupBy(F.col("__at").alias("__s")).agg(F.sum(F.col("__starts").cast("long")).alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for every stretch
    numbered = marked.withColumn("__k", inside).join(F.broadcast(sums.select("__s", earlier.alias("__before"))), F.col("__at") == F.col("__s")).withColumn("__k", F.col("__k") + F.col("__before"))
    least = numbered.groupBy(F.struct(*keys).alias("__key")).agg(F.min("__k").alias("__least"))
    return numbered.join(least, F.struct(*keys).eqNullSafe(F.col("__key"))).select(*plain.columns, (F.col("__k") - F.col("__least")).alias("batch"))


def batch_averages(batches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, items, batches, mean: how the rows of ``batch`` fill their batches."""
    sizes = batches.groupBy(*keys, "batch").agg(F.count("*").alias("n"))
    return sizes.groupBy(*keys).agg(F.sum("n").alias("items"), F.count("*").alias("batches"), F.avg("n").alias("mean"))


def progress(batches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, batch, processed, total: how many rows are done after each batch; there are few batches a key by then."""
    sizes = batches.groupBy(*keys, "batch").agg(F.count("*").alias("n"))
    done = F.sum("n").over(Window.partitionBy(*keys).orderBy("batch"))
    return sizes.select(*keys, "batch", done.alias("processed"), F.sum("n").over(Window.partitionBy(*keys)).alias("total"))


def last_wins(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """One row of each key: the values of its last row, with ``first``, the place of its first."""
    rest = [c for c in rows.columns if c not in keys]
    grouped = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("__row"), F.min(place).alias("first"))
    return grouped.select(*keys, "__row.*", "first")


def stated(rows: DataFrame, found: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows with the values that ``found`` (keys, values) has for them; the others as they are."""
    new = found.select(*keys, *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__found"))
    joined = rows.join(new, keys, "left")
    return joined.select(*[F.when(F.col("__found"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def last_of_conversation(rows: DataFrame, key: str, order: str, number: int = 6) -> DataFrame:
    """The last ``number`` rows of each key, in their order."""
    return first_of_each(rows, [key], [F.desc(order)], number)


#: Names of functions that need no explanation.
SIMPLE_NAMES = ["get", "set", "is", "to_string", "tostring", "equals", "hashcode", "hash", "clone", "compare", "compareto", "equal", "gethashcode", "dispose", "close", "init", "ctor", "constructor", "__init__"]


def is_simple_function(name: Column, parameters: Column, span: Column) -> Column:
    """Whether a function is too simple to explain: by its name, or by few parameters and lines."""
    bare = F.trim(F.lower(name), F.lit("_"))
    return bare.isin(*SIMPLE_NAMES) | ((parameters <= 1) & (span < 5))
