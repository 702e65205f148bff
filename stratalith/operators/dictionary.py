"""Dictionaries: which of many keys occur in each of many texts, by one automaton over all keys and one pass over the texts.

The automaton (Aho-Corasick) is built once and broadcast, so that a task reads each text once whatever the number of keys. Keys of
more than ``MOST_BYTES`` in all are dealt to several automata by their hash, and the texts are read once for each.

Defined results: a null text has no keys, a null key no texts; an empty key is in every text that isn't null; keys that overlap
or lie within each other are all found; a key counts once a text. An empty dictionary or table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Bytes of the keys of one automaton, which takes some 100 times as much memory.
MOST_BYTES = 4 << 20


def automaton(keys: Iterable[str]) -> ahocorasick.Automaton:
    """An automaton whose values are the keys themselves; empty keys are not held."""
    out = ahocorasick.Automaton()
    for k in keys:
        if k:
            out.add_word(k, k)
    out.make_automaton()
    return out


def keys_of(machine: ahocorasick.Automaton, text: str) -> set[str]:
    """The distinct keys in a text."""
    return {k for _, k in machine.iter(text)} if len(machine) else set()


def found_in(texts: DataFrame, keys: DataFrame, text: str = "text", key: str = "key") -> DataFrame:
    """The columns of ``texts`` without ``text``, and ``key``: a row for each key that occurs in a text."""
    spark = texts.sparkSession
    rest = [c for c in texts.columns if c != text]
    kept = keys.select(F.col(key).cast("string").alias("key")).where("key IS NOT NULL").distinct()
    size = kept.agg(F.coalesce(F.sum(F.octet_length("key") + 8), F.lit(0))).first()[0]
    number = max(1, -(-size // MOST_BYTES))
    rows = texts.select(*rest, F.col(text).cast("string").alias("__text"))
    schema = StructType([*(texts.schema[c] for c in rest), *kept.schema])
    parts = []
    for part in range(number):
        own = [r["key"] for r in kept.where(F.pmod(F.xxhash64("key"), F.lit(number)) == part).collect()]
        machine, everywhere = spark.sparkContext.broadcast(automaton(own)), "" in own

        def search(batches: Iterable[pa.RecordBatch], machine=machine, everywhere=everywhere) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places, hits = [], []
                for i, t in enumerate(batch.column(len(rest)).to_pylist()):
                    if t is not None:
                        some = sorted(keys_of(machine.value, t)) + [""] * everywhere
                        places += [i] * len(some)
                        hits += some
                taken = [batch.column(c).take(pa.array(places, pa.int64())) for c in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(hits, pa.string())], [*rest, "key"])

        parts.append(rows.mapInArrow(search, schema))
    return reduce(DataFrame.unionByName, parts)


def labelled(texts: DataFrame, families: list[tuple[str, list[str], bool]], text: str = "text", out: str = "labels") -> DataFrame:
    """``texts`` with ``out`` in place of ``text``: the labels, in the order of ``families`` (label, patterns, whether case counts), of
    which a pattern occurs in the text. All families are searched in one pass, one automaton for either kind of case."""
    spark = texts.sparkSession
    rest = [c for c in texts.columns if c != text]
    place: dict[tuple[bool, str], set[int]] = {}
    for i, (_, patterns, cased) in enumerate(families):
        for p in patterns:
            place.setdefault((cased, p if cased else p.lower()), set()).add(i)
    names = [label for label, _, _ in families]
    both = spark.sparkContext.broadcast([(automaton(p for c, p in place if c == cased), {p: sorted(v) for (c, p), v in place.items() if c == cased}) for cased in (True, False)])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = []
            for t in batch.column(len(rest)).to_pylist():
                hits: set[int] = set()
                for (machine, of), way in zip(both.value, (t, None if t is None else t.lower()), strict=True):
                    if way is not None:
                        hits.update(i for k in keys_of(machine, way) for i in of[k])
                labels.append([n for n in dict.fromkeys(names[i] for i in sorted(hits))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(rest))), pa.array(labels, pa.list_(pa.string()))], [*rest, out])

    rows = texts.select(*rest, F.col(text).cast("string").alias("__text"))
    schema = StructType([*(texts.schema[c] for c in rest)]).add(out, ArrayType(StringType()))
    return rows.mapInArrow(search, schema)
