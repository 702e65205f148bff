"""Whether one node reaches another, for tables of pairs, from stored labels.

The labels are made on the condensation, in ``RANKS`` orders of its nodes (the first by degree, so that hubs lead; the others by
hashes): the least node of each order that a node reaches, and the least that reaches it. They answer most pairs by themselves:
* No, if the target reaches a lesser node than the source does, or is reached from no node as little as one that reaches the source.
* Yes, if both are in one component, or if a node named in the source's labels as reached is named in the target's as reaching.
Other pairs are searched from their source on, along nodes whose labels leave a way to the target possible.

Labels take rounds of a step along the edges and a jump (see ``components``), so that they don't follow the longest way.

Defined results: every node reaches itself, be it in the edges or not; a pair with a null end is answered with null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import condensed, strong_components, turned
from .storage import stored

RANKS = 4


def least_ends(ranked: DataFrame, ways: DataFrame) -> DataFrame:
    """(way, node, k, least): the least rank in each order k of what each node reaches along the edges of a way, itself included, from
    (node, ranks: structs with the node as ``id``) and edges (way, src, dst). All ways and orders go together."""
    own = ranked.select("node", F.posexplode("ranks").alias("k", "least"))
    found = stored(own.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), "node", "k", "least"), "least")
    while True:
        told = ways.join(found.withColumnRenamed("node", "dst"), ["way", "dst"]).groupBy("way", F.col("src").alias("node"), "k").agg(F.min("least").alias("told"))
        one = stored(found.join(told, ["way", "node", "k"], "left").select("way", "node", "k", F.col("least").alias("before"), F.least("least", F.coalesce("told", "least")).alias("least")), "least")
        jump = one.select("way", "k", F.col("node").alias("at"), F.col("least").alias("far"))
        found = stored(one.withColumn("at", F.col("least.id")).join(jump, ["way", "k", "at"]).select("way", "node", "k", "before", F.least("least", "far").alias("least")), "least")
        if found.where("before != least").isEmpty():
            return found.select("way", "node", "k", "least")


@dataclass(frozen=True)
class Reachability:
    """``components`` (node, component), ``edges`` of the condensation, ``labels`` (node, reached, reaching: arrays by order)."""

    components: DataFrame
    edges: DataFrame
    labels: DataFrame


def labelled(edges: DataFrame) -> Reachability:
    """The labels of the nodes of the edges (src, dst)."""
    parts = stored(strong_components(edges), "components")
    between = stored(condensed(edges, parts).select("src", "dst"), "condensed")
    ends = between.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    nodes = parts.select(F.col("component").alias("node")).distinct().join(ends, "node", "left")
    orders = [-F.coalesce("degree", F.lit(0)), *[F.xxhash64("node", F.lit(seed)) for seed in range(1, RANKS)]]
    ranked = nodes.select("node", F.array(*[F.struct(o.cast("bigint").alias("by"), F.col("node").alias("id")) for o in orders]).alias("ranks"))
    ways = stored(between.withColumn("way", F.lit(0)).unionByName(turned(between).withColumn("way", F.lit(1))), "ways")
    ends_of = least_ends(stored(ranked, "ranked"), ways)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("k", "least"))), lambda x: x["least"])
    lists = ends_of.groupBy("node", "way").agg(in_order.alias("least"))  # RANKS each
    both = [lists.where(F.col("way") == way).select("node", F.col("least").alias(name)) for way, name in enumerate(("reached", "reaching"))]
    return Reachability(parts, between, stored(both[0].join(both[1], "node"), "labels"))


def impossible(a: str, b: str) -> Column:
    """Whether the labels of ``a`` and ``b`` rule out that a reaches b."""
    less = F.exists(F.zip_with(F.col(f"{a}_reached"), F.col(f"{b}_reached"), lambda x, y: y < x), lambda v: v)
    back = F.exists(F.zip_with(F.col(f"{a}_reaching"), F.col(f"{b}_reaching"), lambda x, y: x < y), lambda v: v)
    return less | back


def certain(a: str, b: str) -> Column:
    """Whether the labels name a node on the way."""
    return (F.col(a) == F.col(b)) | F.arrays_overlap(F.transform(f"{a}_reached", lambda x: x["id"]), F.transform(f"{b}_reaching", lambda x: x["id"]))


def side(labels: DataFrame, name: str) -> DataFrame:
    return labels.select(F.col("node").alias(name), F.col("reached").alias(f"{name}_reached"), F.col("reaching").alias(f"{name}_reaching"))


def decided(pairs: DataFrame, index: Reachability) -> DataFrame:
    """Distinct (src, dst, a, b, answer) of pairs with known, different ends: components and the labels' answer, null if open."""
    asked = pairs.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    of = index.components
    met = asked.join(of.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    met = met.join(side(index.labels, "a"), "a").join(side(index.labels, "b"), "b")
    answer = F.when(certain("a", "b"), True).when(impossible("a", "b"), False)
    return met.select("src", "dst", "a", "b", answer.alias("answer"))


def reaches(pairs: DataFrame, index: Reachability) -> DataFrame:
    """src, dst, reached of each pair (src, dst)."""
    known = stored(decided(pairs, index), "decided")
    open_ = stored(known.where("answer IS NULL").select("a", "b").distinct(), "open")
    seen, frontier, hits = open_.select("a", "b", F.col("a").alias("x")), open_.select("a", "b", F.col("a").alias("x")), []
    while not frontier.isEmpty():
        step = frontier.join(index.edges.select(F.col("src").alias("x"), F.col("dst").alias("next")), "x").select("a", "b", F.col("next").alias("x")).distinct()
        met = step.join(seen, ["a", "b", "x"], "left_anti").join(side(index.labels, "x"), "x").join(side(index.labels, "b"), "b").where(~impossible("x", "b"))
        met = stored(met.select("a", "b", "x", certain("x", "b").alias("hit")), "met")
        hits.append(met.where("hit").select("a", "b"))
        done = met.where("hit").select("a", "b").distinct()
        frontier = stored(met.join(done, ["a", "b"], "left_anti").select("a", "b", "x"), "frontier")
        seen = seen.unionByName(frontier)
    found = open_.where("false")
    for h in hits:
        found = found.unionByName(h)
    found = found.distinct().withColumn("found", F.lit(True))
    answers = known.join(found, ["a", "b"], "left").select("src", "dst", F.coalesce("answer", "found", F.lit(False)).alias("answer"))
    rows = pairs.join(answers.select(F.col("src").alias("s"), F.col("dst").alias("d"), "answer"), (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")), "left")
    self_or_unknown = F.when(F.col("src").isNull() | F.col("dst").isNull(), F.lit(None).cast("boolean")).otherwise(F.col("src") == F.col("dst"))
    return rows.select("src", "dst", F.coalesce("answer", self_or_unknown).alias("reached"))
