"""Strongly connected components of directed edges, the condensation, and what lies on circles.

1. Trimming: a node without an edge in or without an edge out is a component of its own.
2. Only ways: nodes with one edge out are followed to where they lead by pointer doubling, so that a chain of n nodes takes log n
   rounds. A circle of such nodes is a component; other chains are left out and their last node stands for them, until its component
   is known: then those nodes belong to it that one of its members leads to. The same holds for nodes with one edge in.
3. Many pivots at once: every node learns the greatest node before it and after it, a step along the edges and a jump to what the node
   found so far has found itself. Edges between nodes that differ go. When none goes, the parts left are the components.
The three are repeated on what is left. Each round is stored.

Defined results: rows with a null end are no edges; loops and repeated edges change nothing; a node without any edge is not in the
tables of edges and so has no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Chains are followed while at least this share of the nodes are on them.
LEAST_SHARE = 0.05


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges between nodes that have an edge in and one out."""
    heads, tails = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst")


@dataclass
class Chains:
    """Nodes that were left out, with the pointers of each doubling (node, to), their ``ends`` (node, root), and the edges
    (src, dst) that led to them from nodes that stayed. ``back``: whether the edges were turned."""

    steps: list[DataFrame]
    ends: DataFrame
    entries: DataFrame
    back: bool


def followed(edges: DataFrame, back: bool) -> tuple[DataFrame, DataFrame | None, Chains | None]:
    """What is left of the edges without chains, the components (node, component) found on the way, and the chains."""
    way = turned(edges) if back else edges
    only = stored(way.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to")).where("n = 1").select(F.col("src").alias("node"), "to"), "only")
    number = only.count()
    if number == 0 or number < LEAST_SHARE * nodes_of(edges).count():
        return edges, None, None
    steps = [only.withColumn("least", F.least("node", "to"))]
    reach = 1
    while reach < number:
        last = steps[-1]
        on = last.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("least").alias("more"))
        if last.join(on.select("to"), "to", "left_semi").isEmpty():
            break  # all pointers have left the chains
        steps.append(stored(last.join(on, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.least("least", F.coalesce("more", "least")).alias("least")), "steps"))
        reach *= 2
    ends = steps[-1]
    inside = ends.join(only.select(F.col("node").alias("to")), "to", "left_semi")  # these never leave: they end on circles
    circles = inside.select(F.col("to").alias("node")).distinct()
    found = stored(ends.join(circles, "node").select("node", F.col("least").alias("component")), "circles")
    roots = stored(ends.join(inside.select("node"), "node", "left_anti").select("node", F.col("to").alias("root")), "roots")
    gone = only.select("node")
    kept = way.join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
    kept = kept.join(inside.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    entries = stored(kept.join(roots.select(F.col("node").alias("dst"), "root"), "dst").select("src", "dst", "root"), "entries")
    moved = kept.join(roots.select(F.col("node").alias("dst"), "root"), "dst", "left").select("src", F.coalesce("root", "dst").alias("dst")).where("src != dst").distinct()
    moved = stored(turned(moved) if back else moved, "edges")
    return moved, found, Chains([s.select("node", "to") for s in steps], roots, entries, back)


def rejoined(chains: Chains, components: DataFrame) -> DataFrame:
    """(node, component) of the nodes on chains that belong to the component of their root: those on the way from a node that a
    member of the component leads to."""
    of = components.select("node", "component")
    named = chains.entries.join(of.select(F.col("node").alias("src"), F.col("component").alias("c")), "src", "left").join(of.select(F.col("node").alias("root"), F.col("component").alias("d")), "root", "left")
    inner = named.where(F.coalesce("c", "src") == F.coalesce("d", "root"))
    marked = stored(inner.select(F.col("dst").alias("node")).distinct(), "marked")
    if marked.isEmpty():
        return of.where("false")
    for step in chains.steps:
        further = step.join(marked, "node", "left_semi").select(F.col("to").alias("node"))
        marked = stored(marked.unionByName(further).distinct(), "marked")
    members = chains.ends.join(marked, "node", "left_semi").join(of.select(F.col("node").alias("root"), "component"), "root", "left")
    inside = members.select("node", F.coalesce("component", "root").alias("component"))
    # The root itself, if its component is known by its chains only.
    return inside.unionByName(members.select(F.col("root").alias("node"), F.coalesce("component", "root").alias("component"))).distinct()


def greatest_before(edges: DataFrame) -> DataFrame:
    """(node, greatest): the greatest node from which each node can be reached, itself included."""
    found = stored(nodes_of(edges).select("node", F.col("node").alias("greatest")), "greatest")
    while True:
        told = found.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("greatest").alias("told"))
        one = found.join(told, "node", "left").select("node", F.col("greatest").alias("before"), F.greatest("greatest", F.coalesce("told", "greatest")).alias("greatest"))
        one = stored(one, "greatest")
        jump = one.select(F.col("node").alias("greatest"), F.col("greatest").alias("far"))
        found = stored(one.join(jump, "greatest").select("node", "before", F.greatest("greatest", "far").alias("greatest")), "greatest")
        if found.where("before != greatest").isEmpty():
            return found.select("node", "greatest")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (src, dst); a component is named by its least node."""
    plain = stored(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "edges")
    left = stored(trimmed(plain.where("src != dst")), "edges")
    frames: list[Chains] = []
    found: list[DataFrame] = []
    n = left.count()
    while n:
        before = n
        for back in (False, True):
            left, circles, chains = followed(left, back)
            if chains is not None:
                frames.append(chains)
                found.append(circles)
        left = stored(trimmed(left), "edges")
        n = left.count()
        if n > before * (1 - LEAST_SHARE):  # few chains: many pivots
            first, last = greatest_before(left), greatest_before(turned(left))
            both = stored(first.join(last.withColumnRenamed("greatest", "after"), "node"), "parts")
            src = both.select(F.col("node").alias("src"), F.struct("greatest", "after").alias("s"))
            dst = both.select(F.col("node").alias("dst"), F.struct("greatest", "after").alias("d"))
            cut = stored(left.join(src, "src").join(dst, "dst").where("s = d").select("src", "dst"), "edges")
            number = cut.count()
            if number == n:
                found.append(both.select("node", F.col("greatest").alias("component")))
                break
            left = stored(trimmed(cut), "edges")
            n = left.count()
    known = plain.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
    for part in found:
        known = known.unionByName(part)
    known = stored(known, "components")
    for chains in reversed(frames):
        more = rejoined(chains, known).join(known, "node", "left_anti")
        known = stored(known.unionByName(more), "components")
    every = nodes_of(plain).join(known, "node", "left").select("node", F.coalesce("component", "node").alias("of"))
    names = every.groupBy("of").agg(F.min("node").alias("component"))
    return every.join(names, "of").select("node", "component")


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst, n): the numbers of edges between different components."""
    src = components.select(F.col("node").alias("src"), F.col("component").alias("a"))
    dst = components.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    pairs = edges.select("src", "dst").distinct().join(src, "src").join(dst, "dst").where("a != b")
    return pairs.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("n"))


def circular(components: DataFrame) -> DataFrame:
    """(component, node, size) of the nodes in components of more than one node: those that lie on circles."""
    large = components.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return components.join(large, "component").select("component", "node", "size")
