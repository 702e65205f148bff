"""Answers from labels against a closure."""

import random

import pytest

from stratalith.operators import reachability
from test_components import shape


def closure(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    found = {}
    for n in {x for e in edges for x in e}:
        known, todo = {n}, [n]
        while todo:
            for y in after.get(todo.pop(), ()):
                if y not in known:
                    known.add(y)
                    todo.append(y)
        found[n] = known
    return found


def layered(rng):
    """Ten layers of ten nodes, two ways on from each."""
    return [(10 * k + i, 10 * (k + 1) + rng.randrange(10)) for k in range(9) for i in range(10) for _ in range(2)]


@pytest.mark.parametrize("kind", ["sparse", "circles", "layered"])
def test_all_pairs(spark, kind):
    rng = random.Random(kind)
    edges = layered(rng) if kind == "layered" else shape(kind, rng)
    true = closure(edges)
    nodes = sorted(true)
    pairs = [(a, b) for a in nodes for b in nodes if rng.random() < 0.6] + [(nodes[0], nodes[1])] * 2 + [(10**6, 10**6), (10**6, nodes[0]), (None, nodes[0]), (nodes[0], None)]
    index = reachability.labelled(spark.createDataFrame(edges, "src long, dst long"))
    asked = spark.createDataFrame(pairs, "src long, dst long")
    got = sorted((tuple(r) for r in reachability.reaches(asked, index).collect()), key=str)
    wanted = [(a, b, None if a is None or b is None else a == b or b in true.get(a, ())) for a, b in pairs]
    assert got == sorted(wanted, key=str)
    share = reachability.decided(asked, index).where("answer IS NULL").count() / len(pairs)
    assert share < 0.3  # most need no search


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    index = reachability.labelled(none)
    assert [tuple(r) for r in reachability.reaches(spark.createDataFrame([("a", "a"), ("a", "b")], none.schema), index).orderBy("dst").collect()] == [("a", "a", True), ("a", "b", False)]
    assert reachability.reaches(none, index).count() == 0
