"""Call and dependency graphs over edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import dotted, mermaid_id, module_of, simple_name
from . import components
from .storage import stored

#: Members by which a group of circular dependencies is shown.
SHOWN = 20
#: Importers of a name, and modules that it meets, in a cell of their product.
CELL = 1024


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges (src, dst) of calls (caller, callee name) to functions (id, pos).

    A name with one function is that function; else the first one of the caller's module; else the first three. The join
    is on the simple name, with one row of choices a name; a frequent name's calls are split by adaptive execution.
    """
    named = functions.select("id", "pos", simple_name(F.col("id")).alias("name"), module_of(F.col("id")).alias("module"))
    of_name = named.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("only"))
    first3 = Window.partitionBy("name").orderBy("pos", "id")
    first = named.withColumn("r", F.row_number().over(first3)).where("r <= 3").groupBy("name").agg(F.collect_list("id").alias("firsts"))
    local = Window.partitionBy("name", "module").orderBy("pos", "id")
    own = named.withColumn("r", F.row_number().over(local)).where("r = 1").select("name", "module", F.col("id").alias("own"))
    asked = calls.select(F.col("caller").alias("src"), F.substring_index("callee", ".", -1).alias("name"), module_of(F.col("caller")).alias("module")).distinct()
    found = asked.join(of_name, "name").join(own, ["name", "module"], "left").join(first, "name")
    targets = F.when(F.col("n") == 1, F.array("only")).when(F.col("own").isNotNull(), F.array("own")).otherwise(F.col("firsts"))
    return found.select("src", F.explode(targets).alias("dst")).distinct()


def grams(text: str, size: int) -> Column:
    """The distinct substrings of ``size`` characters."""
    n = F.length(text)
    places = F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)))
    return F.when(n >= size, F.array_distinct(F.transform(places, lambda i: F.substring(F.col(text), i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole) where the whole contains the part, both distinct and not null.

    A part of three characters or more meets only the wholes with its rarest trigram; a shorter part is a gram itself.
    """
    listed = wholes.select("whole", F.explode(grams("whole", 3)).alias("gram"))
    counts = listed.groupBy("gram").agg(F.count("*").alias("n"))
    asked = parts.where(F.length("part") >= 3).select("part", F.explode(grams("part", 3)).alias("gram")).join(counts, "gram", "left")
    # A part with a trigram that no whole has can't be contained; its least count is then 0 and finds nothing.
    anchor = asked.groupBy("part").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    found = anchor.join(listed, "gram").where(F.contains("whole", F.col("part"))).select("part", "whole")
    for size in (1, 2):
        short = parts.where(F.length("part") == size)
        found = found.unionByName(wholes.select(F.explode(grams("whole", size)).alias("part"), "whole").join(short, "part"))
    return found


def module_dependencies(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, depends_on) of imports (path, module) where one of the imported name and a module's dotted path contains the
    other.

    The pairs may be quadratically many, so they are made once, by the join that ends the plan, and never gathered: of several
    imported names that lead from one path to the same module only the first makes the pair. A name's importers and modules
    meet in cells of at most ``CELL`` of either.
    """
    asked = stored(imports.select("path", "module").where("module <> ''").distinct(), "imports")
    names = asked.select("module").distinct()
    paths = modules.select(F.col("path").alias("depends_on"), dotted(F.col("path")).alias("dotted")).distinct()
    inner, outer = names.select(F.col("module").alias("part")), paths.select(F.col("dotted").alias("whole")).distinct()
    inside = contained(inner, outer).select(F.col("part").alias("module"), F.col("whole").alias("dotted"))
    around = contained(outer.select(F.col("whole").alias("part")), inner.select(F.col("part").alias("whole"))).select(F.col("whole").alias("module"), F.col("part").alias("dotted"))
    met = stored(inside.unionByName(around).distinct().join(paths, "dotted").select("module", "depends_on", "dotted"), "met")
    number = lambda rows, name: rows.groupBy("module").agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))
    cells = stored(number(asked, "rows").join(number(met, "columns"), "module"), "cells")
    used = asked.join(cells, "module")
    before = F.array_sort(F.collect_set("module").over(Window.partitionBy("path")))
    left = used.select("path", "module", "rows", "columns", before.alias("names")).withColumn("names", F.filter("names", lambda n: n < F.col("module")))
    place = lambda c, most: F.pmod(F.xxhash64(c), F.col(most)).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))
    key = ["module", "row", "column"]
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as given: few bytes make many pairs
    left = left.select("path", "names", "module", place("path", "rows").alias("row"), every("columns").alias("column")).repartition(parts, *key)
    right = met.join(cells, "module").select("depends_on", "dotted", "module", every("rows").alias("row"), place("depends_on", "columns").alias("column")).repartition(parts, *key)
    told = F.exists("names", lambda n: F.contains(F.col("dotted"), n) | F.contains(n, F.col("dotted")))
    return left.join(right, key).where(~told).select("path", "depends_on")


def depended_by(dependencies: DataFrame) -> DataFrame:
    """(path, depended_by): the inverse of (path, depends_on), whose rows are distinct."""
    return dependencies.select(F.col("depends_on").alias("path"), F.col("path").alias("depended_by"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, n_in, n_out of every node."""
    end = lambda c, i, o: F.struct(F.col(c).alias("id"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = edges.select(F.explode(F.array(end("dst", 1, 0), end("src", 0, 1))).alias("e")).select("e.*")
    counted = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("n_in", F.lit(0)).cast("bigint").alias("n_in"), F.coalesce("n_out", F.lit(0)).cast("bigint").alias("n_out"))


def entry_points(degree: DataFrame) -> DataFrame:
    """Nodes that nothing calls, those that call most first."""
    return degree.where("n_in = 0").orderBy(F.desc("n_out"), "id")


def most_called(degree: DataFrame, number: int) -> DataFrame:
    return degree.orderBy(F.desc("n_in"), "id").limit(number)


def module_graph(edges: DataFrame) -> DataFrame:
    """(src_module, dst_module, n) of edges between modules."""
    pairs = edges.select(module_of(F.col("src")).alias("src_module"), module_of(F.col("dst")).alias("dst_module"))
    return pairs.where("src_module <> dst_module").groupBy("src_module", "dst_module").agg(F.count("*").alias("n"))


def call_index(edges: DataFrame) -> DataFrame:
    """Edges in both directions."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth) by breadth-first frontiers: each round joins the frontier with the edges and drops what is
    known, so every node is expanded once per start. Rounds are stored, and end early if nothing new is found."""
    edges = stored(edges.select("src", "dst"), "edges")
    known = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).cast("bigint").alias("depth"))
    frontier = known
    for d in range(1, depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(known, ["start", "node"], "left_anti").withColumn("depth", F.lit(d).cast("bigint")), "frontier")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """(path, length) of all simple cycles of 2 to ``longest`` nodes, each once, from its least node on.

    Paths grow by joins, only over nodes greater than their start; nodes without an edge in and out are trimmed first.
    """
    alive = edges.where("src <> dst").select("src", "dst").distinct()
    for _ in range(2):
        heads, tails = alive.select(F.col("src").alias("dst")).distinct(), alive.select(F.col("dst").alias("src")).distinct()
        alive = alive.join(heads, "dst", "left_semi").join(tails, "src", "left_semi").select("src", "dst")
    paths = alive.where("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    found = None
    for length in range(2, longest + 1):
        closed = paths.join(alive, (F.col("last") == F.col("src")) & (F.col("start") == F.col("dst"))).select("path", F.lit(length).cast("bigint").alias("length"))
        found = closed if found is None else found.unionByName(closed)
        if length < longest:
            grown = paths.join(alive, F.col("last") == F.col("src")).where("dst > start").where(~F.array_contains("path", F.col("dst")))
            paths = grown.select("start", F.col("dst").alias("last"), F.array_append("path", F.col("dst")).alias("path"))
    return found


def greatest_before(edges: DataFrame) -> DataFrame:
    """(node, greatest): the greatest node from which each node can be reached, itself included."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    found = stored(ends.select("node", F.col("node").alias("greatest"), F.lit(True).alias("new")), "greatest")
    while not found.where("new").isEmpty():
        told = found.where("new").join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("greatest").alias("told"))
        new = F.coalesce(F.col("told") > F.col("greatest"), F.lit(False))
        found = stored(found.drop("new").join(told, "node", "left").select("node", F.when(new, F.col("told")).otherwise(F.col("greatest")).alias("greatest"), new.alias("new")), "greatest")
    return found.select("node", "greatest")


def on_cycles(edges: DataFrame) -> DataFrame:
    """The distinct edges within strongly connected components, without loops.

    An edge goes if its ends differ in the greatest node before or after them. Once no edge goes, the greatest node of each
    connected part reaches all of it and is reached from all of it.
    """
    left = stored(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    n = left.count()
    while n:
        before, after = greatest_before(left), greatest_before(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        both = before.join(after.withColumnRenamed("greatest", "after"), "node").select("node", F.struct("greatest", "after").alias("at"))
        src, dst = both.select(F.col("node").alias("src"), F.col("at").alias("src_at")), both.select(F.col("node").alias("dst"), F.col("at").alias("dst_at"))
        left = stored(left.join(src, "src").join(dst, "dst").where("src_at = dst_at").select("src", "dst"), "edges")
        last, n = n, left.count()
        if n == last:
            break
    return left


def all_cycles(edges: DataFrame, longest: int) -> DataFrame:
    """(path, length, truncated) of all simple cycles, each once, from its least node on.

    The search ends by itself when no path can grow. If paths are left at ``longest`` nodes, each of their starts gives one
    row (its node alone, no length) with ``truncated``: it may have longer cycles.
    """
    alive = on_cycles(edges)
    paths = alive.where("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    ends = alive.select(F.col("src").alias("last"), F.col("dst").alias("next"))
    found = None
    for length in range(2, longest + 1):
        paths = stored(paths, "paths")
        closed = paths.join(ends, "last").where("next = start").select("path", F.lit(length).cast("bigint").alias("length"), F.lit(False).alias("truncated"))
        found = closed if found is None else found.unionByName(closed)
        grown = paths.join(ends, "last").where("next > start").where(~F.array_contains("path", F.col("next")))
        paths = grown.select("start", F.col("next").alias("last"), F.array_append("path", F.col("next")).alias("path"))
        if paths.isEmpty():
            return found
    cut = paths.select("start").distinct().select(F.array("start").alias("path"), F.lit(None).cast("bigint").alias("length"), F.lit(True).alias("truncated"))
    return found.unionByName(cut)


def graph_view(edges: DataFrame, word: str | None, most: int = 200) -> DataFrame:
    """The first edges of which an end contains the word (case counts)."""
    chosen = edges if not word else edges.where(F.contains("src", F.lit(word)) | F.contains("dst", F.lit(word)))
    return chosen.orderBy("src", "dst").limit(most)


def view_nodes(view: DataFrame, most: int = 100) -> DataFrame:
    """The first nodes of a bounded view."""
    return view.select(F.explode(F.array("src", "dst")).alias("id")).distinct().orderBy("id").limit(most)


def architecture(modules: DataFrame, module_edges: DataFrame, most: int = 10, circular: bool = False) -> DataFrame:
    """(section, place, value): the numbers of modules and dependencies, then the modules that most others use (``core``), that
    use most others (``entry``) and that stand alone (``independent``), the first ``most`` of each; if asked for, the number of groups
    of modules that depend on each other in circles (``circular_groups``) and the ``most`` largest (``circular``), each by up to
    ``SHOWN`` of its members."""
    degree = degrees(modules.select("id"), module_edges)
    totals = degree.agg(F.count("*").alias("m"), F.sum("n_in").alias("e")).select(F.explode(F.array(F.struct(F.lit("modules").alias("section"), F.col("m").cast("string").alias("value")), F.struct(F.lit("dependencies").alias("section"), F.coalesce("e", F.lit(0)).cast("string").alias("value")))).alias("x")).select("x.section", F.lit(1).cast("bigint").alias("place"), "x.value")

    def part(section: str, rows: DataFrame, order: list[Column]) -> DataFrame:
        place = F.row_number().over(Window.orderBy(*order)).cast("bigint")  # of at most ``most`` rows
        return rows.orderBy(*order).limit(most).select(F.lit(section).alias("section"), place.alias("place"), F.col("id").alias("value"))

    core = part("core", degree.where("n_in > 0"), [F.desc("n_in"), F.col("id")])
    entry = part("entry", degree.where("n_out > 0"), [F.desc("n_out"), F.col("id")])
    alone = part("independent", degree.where("n_in = 0 AND n_out = 0"), [F.col("id")])
    rows = totals.unionByName(core).unionByName(entry).unionByName(alone)
    if not circular:
        return rows
    groups = components.circular(components.strong_components(module_edges))
    sizes = groups.groupBy("component").agg(F.max("size").alias("size"))
    number = sizes.agg(F.count("*").alias("n")).select(F.lit("circular_groups").alias("section"), F.lit(1).cast("bigint").alias("place"), F.col("n").cast("string").alias("value"))
    largest = sizes.orderBy(F.desc("size"), "component").limit(most).withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "component")).cast("bigint"))
    shown = groups.join(F.broadcast(largest.select("component", "place")), "component").withColumn("r", F.row_number().over(Window.partitionBy("component").orderBy("node"))).where(F.col("r") <= SHOWN)
    named = shown.groupBy("place").agg(F.array_join(F.array_sort(F.collect_list("node")), " > ").alias("value"))
    return rows.unionByName(number).unionByName(named.select(F.lit("circular").alias("section"), "place", "value"))


def mermaid(edges: DataFrame) -> DataFrame:
    """One text: the edges as a flow chart (for a bounded view of a graph)."""
    line = F.concat(F.lit("    "), mermaid_id(F.col("src")), F.lit(" --> "), mermaid_id(F.col("dst")))
    return edges.agg(F.concat(F.lit("graph TD\n"), F.array_join(F.array_sort(F.collect_set(line)), "\n")).alias("chart"))
