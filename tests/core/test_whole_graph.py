import random

from stratalith import queries
from stratalith.operators import graph

SF = "/root/testdata/sf0.001"


def brute_chains(edges, starts, depth):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    found = set()
    for s in starts:
        known, frontier = {s}, {s}
        found.add((s, s, 0))
        for d in range(1, depth + 1):
            frontier = {y for x in frontier for y in after.get(x, ())} - known
            known |= frontier
            found |= {(s, y, d) for y in frontier}
    return found


def brute_cycles(edges, longest):
    """All cycles of up to ``longest`` nodes, and the starts of paths that could grow beyond within their component."""
    nodes = {x for e in edges for x in e}
    reach = {(a, b) for a, b, d in brute_chains(edges, nodes, len(nodes))}
    after = {}
    for a, b in edges:
        if a != b and (b, a) in reach:
            after.setdefault(a, set()).add(b)
    found, cut, open_paths = set(), set(), [(a,) for a in after]
    while open_paths:
        path = open_paths.pop()
        for y in after[path[-1]]:
            if y == path[0]:
                found.add(path)
            elif y > path[0] and y not in path:
                if len(path) < longest:
                    open_paths.append((*path, y))
                else:
                    cut.add(path[0])
    return found, cut


def test_chains_and_cycles_of_a_table(spark):
    edges = [tuple(r) for r in queries.part_edges(spark, SF).select("src", "dst").collect()]
    starts = [r.id for r in queries.part_functions(spark, SF).select("id").collect()]
    chains = [(r.start, r.node, r.depth) for r in queries.QUERIES["call_chain_all"](spark, SF).collect()]
    assert len(chains) == len(set(chains)) and set(chains) == brute_chains(edges, starts, 10)
    cycles = queries.QUERIES["cycles_all"](spark, SF).collect()
    found, cut = brute_cycles(edges, 10)
    want = {(">".join(c), len(c), False) for c in found} | {(c, None, True) for c in cut}
    assert {tuple(r) for r in cycles} == want and len(cycles) == len(want)
    assert max(map(len, found)) > 3 and cut


def test_cycles_of_random_edges_and_bound(spark):
    rng = random.Random(4)
    edges = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(26)}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    assert {tuple(r.path) for r in graph.all_cycles(df, 12).collect()} == brute_cycles(edges, 12)[0]
    ring = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)] + [(2, 9), (9, 10)], "src long, dst long")
    assert {tuple(r) for r in graph.on_cycles(ring).collect()} == {(i, (i + 1) % 6) for i in range(6)}
    assert [(r.path, r.length, r.truncated) for r in graph.all_cycles(ring, 6).collect()] == [([0, 1, 2, 3, 4, 5], 6, False)]
    assert [(r.path, r.length, r.truncated) for r in graph.all_cycles(ring, 4).orderBy("path").collect()] == [([0], None, True), ([1], None, True)]
    assert graph.all_cycles(ring.where("src <> 0"), 4).count() == 0
