"""Strong components against a depth-first search."""

import random

import pytest

from stratalith.operators import components, graph


def brute(edges):
    """node -> least node of its component, by two depth-first searches."""
    nodes = {x for e in edges for x in e}
    after, before = {}, {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)
    order, seen = [], set()
    for n in nodes:
        todo = [(n, False)]
        while todo:
            x, left = todo.pop()
            if left:
                order.append(x)
            elif x not in seen:
                seen.add(x)
                todo.append((x, True))
                todo += [(y, False) for y in after.get(x, []) if y not in seen]
    of = {}
    for n in reversed(order):
        if n not in of:
            part, todo = {n}, [n]
            while todo:
                for y in before.get(todo.pop(), []):
                    if y not in of and y not in part:
                        part.add(y)
                        todo.append(y)
            of |= dict.fromkeys(part, min(part))
    return of


def shape(kind, rng):
    n = 60
    if kind == "sparse":
        return [(rng.randrange(n), rng.randrange(n)) for _ in range(70)]
    if kind == "dense":
        return [(rng.randrange(25), rng.randrange(25)) for _ in range(120)]
    if kind == "circles":  # circles with tails, joined one after another
        edges = []
        for k in range(6):
            edges += [(10 * k + i, 10 * k + (i + 1) % 7) for i in range(7)] + [(10 * k + 7, 10 * k), (10 * k + 3, 10 * k + 8), (10 * k + 8, 10 * k + 9)]
        return edges + [(10 * k + 9, 10 * k + 10) for k in range(5)]
    if kind == "chains":  # chains between hubs, some of them back
        edges = []
        for k in range(14):
            chain = [rng.randrange(5), *range(100 + 10 * k, 104 + 10 * k), rng.randrange(5)]
            edges += list(zip(chain, chain[1:], strict=False))
        return edges
    if kind == "tree":
        return [(i, (i - 1) // 2) for i in range(1, 40)] + [((i - 1) // 3 + 100, i + 100) for i in range(1, 40)] + [(0, 100), (120, 30)]
    return [(i, i) for i in range(3)] + [(1, 2), (1, 2), (2, 1)]


@pytest.mark.parametrize("kind", ["sparse", "dense", "circles", "chains", "tree", "loops"])
def test_components_equal_a_search(spark, kind):
    edges = shape(kind, random.Random(kind))
    got = {r["node"]: r["component"] for r in components.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute(edges)


def test_rounds_do_not_follow_the_length(spark, monkeypatch):
    rounds, stored = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: (rounds.append(name), stored(df, name))[1])
    rng = random.Random(3)
    names = rng.sample(range(10**6), 10_000)
    path = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "src long, dst long")
    got = components.strong_components(path)
    assert got.where("node != component").isEmpty() and got.count() == 10_000
    assert len(rounds) < 30
    del rounds[:]
    circle = path.union(spark.createDataFrame([(names[-1], names[0])], "src long, dst long"))
    assert components.strong_components(circle).select("component").distinct().collect() == [(min(names),)]
    assert len(rounds) < 30


def test_empty_null_and_names(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert components.strong_components(none).count() == 0
    some = spark.createDataFrame([("b", "a"), ("a", "b"), (None, "a"), ("c", None), ("c", "a")], none.schema)
    found = components.strong_components(some)
    assert {tuple(r) for r in found.collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert {tuple(r) for r in components.circular(found).collect()} == {("a", "a", 2), ("a", "b", 2)}
    assert [tuple(r) for r in components.condensed(some, found).collect()] == [("c", "a", 1)]


def test_architecture_names_circular_dependencies(spark):
    modules = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "a")], "src string, dst string")
    rows = [tuple(r) for r in graph.architecture(modules, edges, circular=True).collect()]
    assert [r for r in sorted(rows) if r[0].startswith("circular")] == [("circular", 1, "c > d > e"), ("circular", 2, "a > b"), ("circular_groups", 1, "2")]
