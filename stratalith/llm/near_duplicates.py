"""Operator 5, MinHash near-duplicates with HyperMinHash registers.

1. Each text becomes its set of hashed word shingles. Equal sets form one class (copies never meet in pairs).
2. A class has a sketch: of the hashes in each of 128 buckets the least one is kept as a 16-bit register, its count of
   leading zeros and ten bits of mantissa. Four registers make one of 32 band keys.
3. In each band key's group, every class is paired with the group's least class (its pivot), not with all others. The
   share of equal registers, corrected for chance collisions, estimates the similarity of a pair; pairs far below the
   threshold go, the rest are verified on their full sets.
4. Links make components. In a group of several components, the classes outside of the largest are compared with some
   pivots of other components, then with all: no link between components can be lost by the pairing, and a
   group that is one component costs one comparison a member. Pairs of which too few shingles occur in more than one
   component are never made: an exact bound that spares the copies of one text that differ too much to be linked.

A link of similarity 0.75 shares no band key with a probability of about (1 - 0.75 ** 4) ** 32 = 5e-6, and a true pair
falls below the estimate's margin of six standard deviations with less than 1e-8.

Keys that many rows share (a pivot, a band, a shingle, the set of a much copied text) are dealt to several tasks (``dealt``);
the edges of a component's hub are left to the skew handling of adaptive execution. A text is one row and held whole by a
task, with some 60 bytes a word.

Defined results: null and empty texts have no shingles, are linked with nothing and stay; rows with one doc_id are one
node; rows with a null id are linked with nothing, stay, and have a null component; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_text, mix64, numbered, odd_constants, slices, small_batches, stored

WIDTH = 5
THRESHOLD = 75  # of 100
BUCKET_BITS, MANTISSA_BITS, ROWS = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // ROWS
#: Chance collisions of two registers of equal content size and r mantissa bits: this constant / 2 ** r a bucket (HyperMinHash paper).
COLLISIONS = 0.169919487159739093975315012348
SIGMAS = 6.0
#: A table of pairs or ids (at most four numbers a row) of at most so many rows may be broadcast: some 6 MB.
BROADCAST_ROWS = 200_000
#: Rows of one key that one task joins; of shingles, whose rows are small, so many.
PER_TASK, SHINGLES_PER_TASK = 1000, 50_000
#: Pivots of a group in the first round of a mixed group, from its main component and from the others each; then all.
PIVOTS = 8

SKETCHES = "doc_id long, n_shingles long, set_hash binary, sketch binary"
SETS = "doc_id long, n long, shingles binary"


def shingle_sets(texts: Iterable[bytes | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text of a slice."""
    words, bounds, vocab = numbered((t or b"").lower().split() for t in texts)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, vocab), np.uint64, len(vocab))[words] if len(words) else np.zeros(0, np.uint64)
    factors = odd_constants(width, 5)
    n = max(0, len(hashed) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashed[k : k + n] * factors[k]
    total = mix64(total)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= width:
            yield np.unique(total[lo : hi - width + 1])
        elif hi > lo:
            whole = xxhash.xxh3_64_intdigest(b" ".join((b"short", *(vocab[i] for i in words[lo:hi]))))
            yield np.array([whole], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def walks() -> np.ndarray:
    """For each bucket all buckets in an order of its own: where an empty one looks for a value."""
    h = mix64(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(23)).reshape(BUCKETS, BUCKETS)
    return np.argsort(h, axis=1)


WALKS = walks()


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a sorted non-empty set: per bucket 1 + leading zeros << 10 | mantissa of its least hash. An empty
    bucket borrows from the first non-empty one on its walk, so that any register of two sets agrees with the
    probability of their similarity (densified one-permutation hashing), also if the sets are small."""
    out = np.zeros(BUCKETS, np.uint16)
    bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (shingles[first] & np.uint64((1 << (64 - BUCKET_BITS)) - 1)) >> np.uint64(64 - BUCKET_BITS - 53)
    length = np.frexp(rest.astype(np.float64))[1]  # exact: 53 bits
    zeros = 53 - length
    top = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) & np.uint64((1 << 53) - 1)
    out[bucket[first]] = 1 + (zeros << MANTISSA_BITS) + (top >> np.uint64(53 - MANTISSA_BITS)).astype(np.int64)
    empty = np.flatnonzero(out == 0)
    if len(empty):
        walk = WALKS[empty]
        out[empty] = out[walk[np.arange(len(empty)), (out[walk] > 0).argmax(axis=1)]]
    return out


def sketch_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in slices(batches):
        n, digests, sketches = [], [], []
        for s in shingle_sets(texts):
            n.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sketches.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "set_hash", "sketch"])


def set_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in slices(batches):
        sets = list(shingle_sets(texts))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "shingles"])


def band_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, key, rep) of each band of a class."""
    weights = np.arange(BANDS, dtype=np.int32)
    for batch in batches:
        reps = batch.column(0).to_numpy()
        sketches = b"".join(batch.column(1).to_pylist())
        keys = np.frombuffer(sketches, "<u8").reshape(len(reps), BANDS)
        row, band = np.nonzero(keys)
        yield pa.RecordBatch.from_arrays([pa.array(weights[band]), pa.array(keys[row, band].view(np.int64)), pa.array(reps[row])], ["band", "key", "rep"])


def estimated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (a, b, n_a, n_b, sketch_a, sketch_b) the pairs whose estimate does not rule out the threshold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n_a, n_b = (batch.column(k).to_numpy().astype(np.float64) for k in (2, 3))
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (4, 5))
        used = BUCKETS * (1 - (1 - 1 / BUCKETS) ** np.maximum(n_a, n_b))  # buckets with a value of their own
        equal = (a == b).sum(axis=1)
        ratio = np.maximum(n_a, n_b) / np.minimum(n_a, n_b)
        chance = COLLISIONS * 4 * ratio / (1 + ratio) ** 2 / 2**MANTISSA_BITS
        estimate = np.maximum(0, equal / BUCKETS - chance) / (1 - chance)
        least = THRESHOLD / 100
        margin = SIGMAS * np.sqrt(least * (1 - least) / used)
        ok = (estimate >= least - margin) & (100 * np.minimum(n_a, n_b) >= THRESHOLD * np.maximum(n_a, n_b))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))


def intersections(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (a, b, set_a, set_b) the linked pairs (a, b), on full sets."""
    for batch in batches:
        ok: list[bool] = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            ok.append(100 * common >= THRESHOLD * (len(both) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def crowded(rows: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Store (h0, h1, ..., parts) of the keys with more than ``most`` (PER_TASK) rows: the number of parts to deal them to."""
    most = most or PER_TASK
    counted = rows.groupBy(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    return stored(counted.withColumn("__parts", F.ceil(F.col("__n") / most).cast("int")).drop("__n"), "crowded")


def dealt(many: DataFrame, keys: list[str], other: DataFrame, other_keys: list[str], hot: DataFrame, also: str = "true", how: str = "inner") -> DataFrame:
    """``many`` joined with ``other`` by their keys. The rows of the crowded keys ``hot`` (of ``many``) are dealt to their
    parts, each of which gets a copy of the key's rows of ``other``, so that no task has all rows of a key."""
    same = [F.col(a) == F.col(b) for a, b in zip(keys, other_keys, strict=True)]
    number = hot.count()
    if not number:
        return many.join(other, reduce(Column.__and__, same, F.expr(also)), how)
    hot = maybe_broadcast(hot, number)
    parts = F.coalesce("__parts", F.lit(1))

    def parted(df: DataFrame, names: list[str], part: Column, name: str) -> DataFrame:
        met = df.join(hot, reduce(Column.__and__, [F.col(k) == F.col(f"__h{i}") for i, k in enumerate(names)]), "left")
        return met.select(*df.columns, part.alias(name))

    many = parted(many, keys, F.pmod(F.xxhash64(*many.columns), parts), "__part")
    other = parted(other, other_keys, F.explode(F.sequence(F.lit(0), parts - 1)), "__copy")
    return many.join(other, reduce(Column.__and__, [*same, F.col("__part") == F.col("__copy")], F.expr(also)), how).drop("__part", "__copy")


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sketches do not rule out."""
    side = classes.select("rep", "n_shingles", "sketch")
    a, b = (side.select(*[F.col(c).alias(f"{c}_{x}") for c in side.columns]) for x in "ab")
    with_a = dealt(pairs, ["a"], a, ["rep_a"], crowded(pairs, ["a"]))
    joined = dealt(with_a, ["b"], b, ["rep_b"], crowded(pairs, ["b"]))
    return joined.select("a", "b", "n_shingles_a", "n_shingles_b", "sketch_a", "sketch_b").mapInArrow(estimated, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of which the full sets reach the threshold. Each a's set goes to the places of its b's."""
    number = pairs.count()  # two ids each: the bound of what is broadcast
    of_a = sets.select(F.col("doc_id").alias("rep_a"), F.col("shingles").alias("set_a"))
    left = of_a.join(F.broadcast(pairs), F.col("rep_a") == F.col("a")) if number <= BROADCAST_ROWS else dealt(pairs, ["a"], of_a, ["rep_a"], crowded(pairs, ["a"]))
    wanted = pairs.select(F.col("b").alias("__b")).distinct()
    right = sets.join(maybe_broadcast(wanted, number), F.col("doc_id") == F.col("__b"), "left_semi").select(F.col("doc_id").alias("rep_b"), F.col("shingles").alias("set_b"))
    joined = dealt(left.select("a", "b", "set_a"), ["b"], right, ["rep_b"], crowded(pairs, ["b"]))
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(intersections, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): its least reachable node, by alternating star contraction."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = stored(small.where("u != v").distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def stars(edges: DataFrame) -> bool:
    """Whether every node has at most one edge to a lesser node, and that has none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty()


def empty_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "a long, b long")


def shingle_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, component, shingle) of each shingle of (rep, component, shingles)."""
    for batch in batches:
        sets = batch.column(2).to_pylist()
        n = np.array([len(s) // 8 for s in sets], np.int64)
        columns = [pa.array(np.repeat(batch.column(k).to_numpy(), n)) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.frombuffer(b"".join(sets), np.int64))], ["rep", "component", "shingle"])


def common_shingles(open_groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(__rep, n, h0, h1, ...) of the classes of open groups: the number of their shingles, and how many of those that
    occur in another component have each hash remainder.

    Two classes x, y of different components have at most i = least(x.h0, y.h0) + least(x.h1, y.h1) + ... shingles in
    common, so their similarity is at most i / (n_x + n_y - i). A rep with several sets (rows of one doc_id) gets no bound.
    """
    hard = open_groups.select(F.col("rep").alias("__rep"), F.col("component").alias("__component")).distinct()
    own = sets.join(maybe_broadcast(hard, hard.count()), F.col("doc_id") == F.col("__rep"))
    rows = stored(own.select("__rep", "__component", "shingles").mapInArrow(shingle_rows, "rep long, component long, shingle long"), "shingles")
    shared = rows.groupBy(F.col("shingle").alias("__shared")).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("__shared")
    part = F.pmod("shingle", F.lit(PARTS))
    parts = dealt(rows, ["shingle"], shared, ["__shared"], crowded(rows, ["shingle"], SHINGLES_PER_TASK)).groupBy("rep").agg(*[F.count(F.when(part == k, 1)).alias(f"h{k}") for k in range(PARTS)])
    n = own.groupBy("__rep").agg(F.count("*").alias("sets"), F.max("n").alias("n"))
    bound = n.join(parts, F.col("__rep") == F.col("rep"), "left")
    single = F.col("sets") == 1
    return bound.select("__rep", F.when(single, F.col("n")).otherwise(0).alias("n"), *[F.when(single, F.coalesce(f"h{k}", F.lit(0))).otherwise(1 << 30).cast("int").alias(f"h{k}") for k in range(PARTS)])


#: Remainders by which shared shingles are counted.
PARTS = 32
COMMON = " + ".join(f"least(h{k}, ph{k})" for k in range(PARTS))
#: Whether the bound leaves a member and a pivot a chance.
POSSIBLE = f"component != pc AND {100 + THRESHOLD} * ({COMMON}) >= {THRESHOLD} * (n + pn)"


def class_links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) of the classes that are linked with another one."""
    spark = classes.sparkSession
    bands = classes.select("rep", "sketch").mapInArrow(band_rows, "band int, key long, rep long").select("band", "key", "rep")
    groups = stored(bands.groupBy(F.col("band").alias("gband"), F.col("key").alias("gkey")).agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).where("size > 1"), "groups")
    large = groups.where(F.col("size") > PER_TASK).select(F.col("gband").alias("__h0"), F.col("gkey").alias("__h1"), F.ceil(F.col("size") / PER_TASK).cast("int").alias("__parts"))
    members = stored(dealt(bands, ["band", "key"], groups, ["gband", "gkey"], large).select("band", "key", "rep", "pivot", "size"), "members")
    compared = stored(members.where("rep != pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    involved = members.select(F.col("rep").alias("id")).distinct()
    rows = involved.count()
    if not rows:
        return components(empty_pairs(spark))
    texts = id_text(docs).join(maybe_broadcast(involved, rows), F.col("doc_id") == F.col("id"), "left_semi")
    sets = texts.mapInArrow(set_rows, SETS)
    sets = stored(sets.dropDuplicates(["doc_id", "shingles"]) if repeated_ids(docs) else sets, "sets")
    where = components(verified(stored(plausible(compared, classes), "plausible"), sets))
    members = members.where("size > 2").select("band", "key", "rep")
    bounds, number = None, PIVOTS
    while True:
        members = mixed_groups(members, where)
        if members.isEmpty():
            return where
        if bounds is None:
            bounds = stored(common_shingles(members, sets), "bounds")
        bounded = members.join(bounds, F.col("rep") == F.col("__rep")).drop("__rep")
        new = stored(facing(bounded, number).distinct().join(compared, ["a", "b"], "left_anti"), "pairs")
        if not new.isEmpty():
            compared = compared.unionByName(new)
            links = verified(stored(plausible(new, classes), "plausible"), sets)
            where = components(where.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
        if number is None:
            return where  # all members of all groups were pivots: components only merge, so no pair is left
        number = None
        members = members.select("band", "key", "rep")


def facing(members: DataFrame, number: int | None) -> DataFrame:
    """Pairs (a, b) of a group's classes outside of its largest component with ``number`` pivots of other components
    (all, if None), of those that the bounds leave possible."""
    outside = F.col("component") != F.col("main")
    pivots = members
    if number is not None:
        rank = F.row_number().over(Window.partitionBy("band", "key", "outside").orderBy(F.xxhash64("rep"), "rep"))
        pivots = members.withColumn("outside", outside).withColumn("r", rank).where(F.col("r") <= number)
    pivots = pivots.select(F.col("band").alias("pband"), F.col("key").alias("pkey"), F.col("rep").alias("p"), F.col("component").alias("pc"), F.col("n").alias("pn"), *[F.col(f"h{k}").alias(f"ph{k}") for k in range(PARTS)])
    mine = members.where(outside)
    met = dealt(mine, ["band", "key"], pivots, ["pband", "pkey"], crowded(mine, ["band", "key"]), POSSIBLE)
    return met.select(F.greatest("rep", "p").alias("a"), F.least("rep", "p").alias("b"))


def mixed_groups(members: DataFrame, where: DataFrame) -> DataFrame:
    """The rows (band, key, rep) of groups with several components, with each row's component and the group's largest."""
    placed = members.join(where, F.col("rep") == F.col("node"), "left").select("band", "key", "rep", F.coalesce("component", "rep").alias("component"))
    parts = placed.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("band", "key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    mixed = mixed.select(F.col("band").alias("gband"), F.col("key").alias("gkey"), "main")
    met = dealt(placed, ["band", "key"], mixed, ["gband", "gkey"], crowded(members, ["band", "key"]))
    return stored(met.select(*placed.columns, "main"), "mixed")


def repeated_ids(docs: DataFrame) -> bool:
    return not docs.groupBy(F.col("doc_id").cast("long")).count().where("count > 1").isEmpty()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    sketches = stored(id_text(docs).mapInArrow(sketch_rows, SKETCHES), "sketches")
    named = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(named.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    found = class_links(classes, docs)
    of_class = classes.select("set_hash", "rep").join(found, F.col("rep") == F.col("node"), "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    rows = sketches.select("doc_id", "n_shingles", "set_hash")
    some = rows.where("set_hash IS NOT NULL")  # the empty texts need no class, however many they are
    joined = dealt(some, ["set_hash"], of_class.withColumnRenamed("set_hash", "__class"), ["__class"], crowded(some, ["set_hash"]), how="left").drop("__class")
    joined = joined.unionByName(rows.where("set_hash IS NULL").withColumn("component", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each component, all columns as they are: the one with the least doc_id (null last),
    of rows that share it the one with the least digest of its text. Texts without words stay.

    If ids are repeated or null, rows get numbers in that order first, so that each is judged by its own text.
    """
    if not repeated_ids(docs) and docs.where("doc_id IS NULL").isEmpty():
        return kept_rows(docs, docs["doc_id"].cast("long"))
    order = [F.col("doc_id").cast("long").asc_nulls_last(), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))]
    numbered_rows = stored(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    return kept_rows(numbered_rows, numbered_rows["__row"]).drop("__row")


def kept_rows(docs: DataFrame, number: Column) -> DataFrame:
    """The rows whose ``number`` (distinct, not null) is the least of their component."""
    judged = near_duplicates(docs.select(number.alias("doc_id"), "text"))
    gone = judged.where("NOT kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, number == gone["__gone"], "left_anti")
