"""Operator 12, near-duplicate embeddings by a forest of random-projection trees.

1. Equal vectors form one class; what follows sees classes, so copies never meet in pairs.
2. Each of the trees cuts nodes of more than ``leaf`` classes in two, at the median of their projections on a random
   direction of the node's own. Classes within ``SPILL`` of the cut go to both sides. Medians come from at most ``sample``
   classes of a node (those with the least hashes), several levels at a time; every class is routed by all cuts. Nodes that are
   still too large after a round are cut on in the next one, from a sample of their own.
3. The classes of a leaf are compared, all with all. A leaf that no cut divides (a dense group) is dealt in blocks to
   several tasks, so that none holds more than two blocks. A pair is counted in the first of the leaves that it shares
   only: each class brings the list of its leaves. Of the links found in a task one spanning forest goes on, no list of pairs.
4. The forests make components.

A pair of cosine exactly 0.9 is parted by a cut with a probability of about 0.03 (uniform vectors) and is lost if that happens
in all trees: some 5e-5 with 7 levels. Closer pairs are lost more rarely. Links are confirmed on the vectors, so none is below
the threshold.

Defined results: vectors that are null, empty, zero or hold null or non-finite entries link with nothing; vectors of different
width neither. Rows that share an id are vectors of their own; rows without an id link with nothing and have a null component.
Both kinds stay. An empty table gives an empty result. Further columns are ignored.
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
from pyspark.sql.window import Window

from .common import mix64, small_batches, stored
from .near_duplicates import components, crowded, dealt, maybe_broadcast
from .vectors import by_width, id_vector

THRESHOLD = 0.9
#: Half the width of the overlap, as a share of the standard deviation that the difference of two unit vectors at the threshold has on a direction.
SPILL = 0.5
#: A cut that leaves a side with more than this share of the node is none.
MOST_SHARE = 0.9
#: Rows of a block that are compared at once; cosines so near to the threshold are computed anew from the vectors.
STRIP, NEAR = 256, 1e-9
SEED = 12


@dataclass(frozen=True)
class Forest:
    """Sizes of a forest, counted in classes: of a leaf (about), of a node's sample, of a sample's leaf (at least), of a block of a
    large leaf. Leaves whose members are looked up at once. Cuts so few (some 40 bytes each) are broadcast."""

    trees: int = 6
    leaf: int = 2000
    sample: int = 4096
    least_sample: int = 64
    block: int = 4000
    lookup: int = 1024
    broadcast_cuts: int = 100_000


CLASSES = "vec_id long, digest binary, width int, vector binary"


def class_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, digest, width, vector) of each row; vectors that can't be linked have no digest and no vector."""
    for batch in batches:
        n = batch.num_rows
        ids, digests, widths, vectors = batch.column(0), [None] * n, [None] * n, [None] * n
        known = ids.is_valid().to_pylist()
        for width, places, found in by_width(batch.column(1)):
            some = found.any(axis=1)
            for i, v in zip(places[some].tolist(), found[some] + 0.0, strict=True):  # one zero for both signs
                if known[i]:
                    vectors[i], widths[i] = v.tobytes(), width
                    digests[i] = hashlib.blake2b(vectors[i], digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.binary()), pa.array(widths, pa.int32()), pa.array(vectors, pa.binary())], ["vec_id", "digest", "width", "vector"])


def unit_rows(vectors: list[bytes], width: int) -> np.ndarray:
    """Unit vectors as rows, padded with zeros to ``width``."""
    if all(len(v) == 8 * width for v in vectors):
        out = np.frombuffer(b"".join(vectors)).reshape(-1, width)
    else:
        out = np.zeros((len(vectors), width))
        for i, v in enumerate(vectors):
            out[i, : len(v) // 8] = np.frombuffer(v)
    out = out / np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def direction(node: int, width: int) -> np.ndarray:
    g = np.random.default_rng([SEED, node & 0xFFFFFFFF, node >> 32]).standard_normal(width)
    return g / np.linalg.norm(g)


def child(node: int, side: int) -> int:
    """The number of a child: a 63-bit hash of its path. The trees' roots are numbered from 1."""
    return int(mix64(np.array([2 * node + side & 2**64 - 1], np.uint64))[0] >> np.uint64(1))


def overlap(width: int) -> float:
    return SPILL * np.sqrt((2 - 2 * THRESHOLD) / width)


def cuts_of(units: np.ndarray, root: int, size: int, forest: Forest) -> dict[int, float]:
    """node -> cut of the subtree of a node with ``size`` classes, learned from its sample."""
    found, width = {}, units.shape[1]
    todo = [(root, np.arange(len(units)))]
    while todo:
        node, members = todo.pop()
        if size * len(members) <= forest.leaf * len(units) or len(members) < 2 * forest.least_sample:
            continue
        place = units[members] @ direction(node, width)
        cut, half = float(np.median(place)), overlap(width)
        sides = members[place < cut + half], members[place >= cut - half]
        if max(map(len, sides)) <= MOST_SHARE * len(members):
            found[node] = cut
            todo += [(child(node, s), m) for s, m in enumerate(sides)]
    return found


def routed(units: np.ndarray, root: int, cuts: dict[int, float]) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows of units) below the node ``root``."""
    todo, half = [(root, np.arange(len(units)))], overlap(units.shape[1])
    while todo:
        node, members = todo.pop()
        if node not in cuts:
            yield node, members
        elif len(members):
            place = units[members] @ direction(node, units.shape[1])
            todo += [(child(node, 0), members[place < cuts[node] + half]), (child(node, 1), members[place >= cuts[node] - half])]


def samples(members: DataFrame, sizes: DataFrame, classes: DataFrame, number: int) -> DataFrame:
    """(node, size, vector) of at most ``number`` members of each node, those with the least hashes."""
    place = F.xxhash64("cid", F.lit(SEED)).bitwiseAND(F.lit(2**63 - 1)) / F.lit(float(2**63))
    some = members.join(sizes, "node").withColumn("u", place).where(F.col("u") * F.col("size") <= 4 * number)
    rank = F.row_number().over(Window.partitionBy("node").orderBy("u", "cid"))
    return some.withColumn("r", rank).where(F.col("r") <= number).join(classes.select("cid", "vector"), "cid").select("node", "size", "vector")


def below(members: DataFrame, cuts: DataFrame, classes: DataFrame, width: int, broadcast_cuts: int) -> DataFrame:
    """(node, cid) of the leaves that the members (node, cid) of cut nodes reach."""
    number = cuts.agg(F.sum(F.size("nodes"))).first()[0] or 0
    few = {r["node"]: dict(zip(r["nodes"], r["cuts"], strict=True)) for r in cuts.collect()} if number <= broadcast_cuts else None
    rows = members.join(cuts, "node") if few is None else members.where(F.col("node").isin(list(few))).select("*", F.lit(None).alias("nodes"), F.lit(None).alias("cuts"))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, cids = (batch.column(k).to_numpy() for k in (0, 1))
            order = np.argsort(nodes, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(nodes[order])) + 1) if len(order) else []:
                first = int(rows[0])
                own = few[int(nodes[first])] if few is not None else dict(zip(batch.column(2)[first].as_py(), batch.column(3)[first].as_py(), strict=True))
                for leaf, found in routed(unit_rows(batch.column(4).take(pa.array(rows)).to_pylist(), width), int(nodes[first]), own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), leaf, np.int64)), pa.array(cids[rows[found]])], ["node", "cid"])

    return rows.join(classes.select("cid", "vector"), "cid").select("node", "cid", "nodes", "cuts", "vector").mapInArrow(route, "node long, cid long")


def memberships(classes: DataFrame, width: int, forest: Forest = Forest()) -> DataFrame:
    """(leaf, cid): the leaves of each class in all trees."""
    spark = classes.sparkSession
    total = classes.count()
    if total <= forest.leaf:  # one leaf; more trees would repeat it
        return classes.select(F.lit(1).cast("long").alias("leaf"), "cid")
    members = classes.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(forest.trees).cast("long"))).alias("node"), "cid")
    sizes, number = spark.createDataFrame([(t, total) for t in range(1, forest.trees + 1)], "node long, size long"), forest.trees
    done = []

    def learned(frame: pd.DataFrame) -> pd.DataFrame:
        node = int(frame["node"].iat[0])
        found = cuts_of(unit_rows(frame["vector"].tolist(), width), node, int(frame["size"].iat[0]), forest)
        return pd.DataFrame({"node": [node], "nodes": [list(found)], "cuts": [list(found.values())]})

    while number:
        cuts = samples(members, maybe_broadcast(sizes, number), classes, forest.sample).groupBy("node").applyInPandas(learned, "node long, nodes array<long>, cuts array<double>")
        cuts = stored(cuts.where("size(nodes) > 0"), "cuts")
        done.append(members.join(maybe_broadcast(cuts.select("node"), number), "node", "left_anti"))  # what no cut divides
        members = stored(below(members, cuts, classes, width, forest.broadcast_cuts), "members")
        counted = stored(members.groupBy("node").agg(F.count("*").alias("size")), "sizes")
        sizes = counted.where(F.col("size") > 2 * forest.leaf)
        number = sizes.count()
        large = maybe_broadcast(sizes.select("node"), number)
        done.append(members.join(large, "node", "left_anti"))
        members = members.join(large, "node", "left_semi")
    return reduce(DataFrame.unionByName, [d.select(F.col("node").alias("leaf"), "cid") for d in done])


def spanning(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the labels (least place of each row's component) along the edges (a, b)."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def met_before(leaves: list[list[int]], a: np.ndarray, b: np.ndarray, lookup: int) -> np.ndarray:
    """Whether the pairs (a, b) share one of their earlier ``leaves``, which are numbered by place in a list each."""
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(leaves[r]) for r in rows])
    number = np.unique(np.array([x for r in rows for x in leaves[r]], np.int64), return_inverse=True)[1]
    often = np.flatnonzero(np.bincount(number) > 1) if len(number) else number
    left, i = np.unique(at[: len(a)], return_inverse=True)
    right, j = np.unique(at[len(a) :], return_inverse=True)
    out = np.zeros(len(a), bool)
    for start in range(0, len(often), lookup):
        column = np.searchsorted(often[start : start + lookup], number)
        here = (column < len(often[start : start + lookup])) & (often[np.minimum(start + column, len(often) - 1)] == number)
        has = np.zeros((len(rows), lookup), np.float32)
        has[owner[here], column[here]] = 1
        out |= (has[left] @ has[right].T)[i, j] > 0
    return out


def compared(width: int, lookup: int):
    """The function that links the classes of a leaf (leaf, low, high): of one block, or of two with each other."""

    def links(table: pa.Table) -> pa.Table:
        leaf, low, high = (table[c][0].as_py() for c in ("leaf", "low", "high"))
        cids, copies, block, widths = (table[c].to_numpy() for c in ("cid", "copies", "block", "width"))
        vectors = table["vector"].to_pylist()
        units = unit_rows(vectors, width)
        earlier = [[x for x in row if x < leaf] for row in table["leaves"].to_pylist()]
        linked, labels = np.zeros(len(cids), np.int64), np.arange(len(cids))
        left, right = (np.flatnonzero(block == x) for x in (low, high))
        for start in range(0, len(left), STRIP):
            rows = left[start : start + STRIP]
            cosine = units[rows] @ units[right].T
            i, j = np.nonzero(cosine >= THRESHOLD - NEAR)
            a, b, close = rows[i], right[j], cosine[i, j] < THRESHOLD + NEAR
            sure = (a < b if low == high else a != b) & (widths[a] == widths[b])
            a, b, close = a[sure], b[sure], close[sure]
            sure = near_enough(vectors, a, b, close)
            a, b = a[sure], b[sure]
            new = ~met_before(earlier, a, b, lookup)
            a, b = a[new], b[new]
            np.add.at(linked, a, copies[b])
            np.add.at(linked, b, copies[a])
            spanning(labels, a, b)
        some = np.flatnonzero(linked)
        return pa.table({"cid": cids[some], "links": linked[some], "joined": cids[labels[some]]}, pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("joined", pa.int64())]))

    return links


def near_enough(vectors: list[bytes], a: np.ndarray, b: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether the pairs (a, b) that are asked for reach the threshold by their vectors' own sums."""
    out = np.ones(len(a), bool)
    for k in np.flatnonzero(asked).tolist():
        x, y = np.frombuffer(vectors[a[k]]), np.frombuffer(vectors[b[k]])
        if len(x) == len(y):
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            out[k] = float(x @ y) / np.sqrt(float(x @ x) * float(y @ y)) >= THRESHOLD
    return out


def class_links(classes: DataFrame, forest: Forest) -> DataFrame:
    """(cid, links, joined) of linked classes, a row for each leaf: the vectors linked there first, and a class of the same component."""
    width = classes.agg(F.max("width")).first()[0] or 1
    members = stored(memberships(classes, width, forest), "leaves")
    lists = members.groupBy("cid").agg(F.collect_list("leaf").alias("leaves"))  # some dozens, by the trees' depth
    rows = classes.select("cid", "copies", "width", "vector").join(lists, "cid")
    placed = rows.select(F.explode("leaves").alias("leaf"), "*")
    large = stored(members.groupBy(F.col("leaf").alias("large")).agg(F.ceil(F.count("*") / forest.block).cast("int").alias("blocks")).where("blocks > 1"), "large")
    met = placed.join(maybe_broadcast(large, large.count()), F.col("leaf") == F.col("large"), "left")
    blocks = F.coalesce("blocks", F.lit(1))
    cut = met.select("*", F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt_out = cut.select("leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", *rows.columns)
    return dealt_out.groupBy("leaf", "low", "high").applyInArrow(compared(width, forest.lookup), "cid long, links long, joined long")


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", forest: Forest = Forest()) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row."""
    small_batches(rows.sparkSession)
    read = stored(id_vector(rows, vec_id, embedding).mapInArrow(class_rows, CLASSES), "vectors")
    linkable = read.where("digest IS NOT NULL")
    classes = linkable.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("width").alias("width"), F.first("vector").alias("vector"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = stored(class_links(classes, forest), "links")
    joined = components(found.where("cid != joined").select(F.col("cid").alias("a"), F.col("joined").alias("b")))
    counted = found.groupBy("cid").agg(F.sum("links").alias("links"))
    of_class = classes.select("cid", "digest", "rep", "copies").join(counted, "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    of_class = of_class.select(F.col("digest").alias("class"), "rep", F.coalesce("component", "cid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of_class = stored(of_class, "classes")
    least = of_class.groupBy(F.col("component").alias("__component")).agg(F.min("rep").alias("component_id"))
    of_class = dealt(of_class, ["component"], least, ["__component"], crowded(of_class, ["component"])).select("class", "n_links", "component_id")
    some = linkable.select("vec_id", "digest")
    known = dealt(some, ["digest"], of_class, ["class"], crowded(some, ["digest"])).select("vec_id", "n_links", "component_id")
    alone = read.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
