"""Operator 12 against all pairs."""

import numpy as np
import pytest

from stratalith.llm import projection_forest as forest

KINDS = "vec_id long, embedding array<double>, __bad string"


def brute(ids, vectors):
    """n_links and component of each row by all pairs."""
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = (x @ x.T >= forest.THRESHOLD) & ~np.eye(len(x), dtype=bool)
    place, ids = np.arange(len(x)), np.array(ids)
    while True:
        new = np.where(linked, place[None, :], len(x)).min(axis=1)
        new = np.minimum(new, place)
        new = new[new]
        if (new == place).all():
            break
        place = new
    least = {c: ids[place == c].min() for c in set(place.tolist())}
    return {int(i): (int(n), int(least[c])) for i, n, c in zip(ids, linked.sum(axis=1), place.tolist(), strict=True)}


def near(rng, base, cosine):
    """A unit vector of that cosine with ``base``."""
    other = rng.standard_normal(len(base))
    other -= base * (other @ base)
    return cosine * base + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def planted(rng, n, d, groups):
    """Uniform vectors, groups around some of them (size, cosine), and chains."""
    rows = rng.standard_normal((n, d))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    out = list(rows)
    for k, (size, cosine) in enumerate(groups):
        out += [near(rng, rows[k], cosine) for _ in range(size)]
    for k in range(20):  # chains of pairs just above the threshold
        chain = [rows[n - 1 - k]]
        for _ in range(5):
            chain.append(near(rng, chain[-1], 0.905))
        out += chain[1:]
    return np.array(out)[rng.permutation(len(out))]


def test_links_and_components_of_many_leaves(spark):
    small = forest.Forest(leaf=150, sample=1000, block=120)
    rng = np.random.default_rng(5)
    x = planted(rng, 3000, 32, [(400, 0.99), (60, 0.955), *[(3, 0.93)] * 50])
    ids = rng.permutation(len(x)) * 3
    got = forest.near_duplicates(spark.createDataFrame([(int(i), v.tolist(), "b") for i, v in zip(ids, x, strict=True)], KINDS), forest=small).collect()
    wanted = brute(ids, x)
    assert len(got) == len(x)
    links = sum(min(r["n_links"], wanted[r["vec_id"]][0]) for r in got)
    assert all(r["n_links"] <= wanted[r["vec_id"]][0] for r in got)
    assert links >= 0.999 * sum(n for n, _ in wanted.values())
    assert sum(r["component_id"] == wanted[r["vec_id"]][1] for r in got) >= 0.999 * len(x)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_pairs_are_counted_once(spark):
    small = forest.Forest(leaf=150, block=100, lookup=3)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    base /= np.linalg.norm(base)
    x = np.array([near(rng, base, 0.999) for _ in range(500)] + [v for v in planted(rng, 300, 16, [])])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in forest.near_duplicates(spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], KINDS), forest=small).collect()}
    wanted = brute(range(len(x)), x)
    assert all(got[i] == wanted[i] for i in range(500))


def test_trees_go_on_from_samples_of_large_nodes(spark):
    for bound in (100_000, 0):  # cuts broadcast, and joined
        small = forest.Forest(leaf=40, sample=160, least_sample=40, broadcast_cuts=bound)
        rng = np.random.default_rng(7)
        x = planted(rng, 1500, 24, [(2, 0.97)] * 40)
        classes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "cid long, vector binary")
        leaves = forest.memberships(classes, 24, small)
        sizes = [r["count"] for r in leaves.groupBy("leaf").count().collect()]
        assert leaves.select("cid").distinct().count() == len(x)
        assert max(sizes) < len(x) / 4
        together = leaves.groupBy("cid").agg(forest.F.count("*").alias("n")).agg(forest.F.min("n")).first()[0]
        assert together >= small.trees


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0], "a"), (3, [2.0, 0.0], "a"), (4, [1.0, 0.1], None),  # one direction, other lengths
        (7, [1.0, 0.0], "a"), (7, [1.0, 0.0], "a"),  # one id twice
        (8, [-1.0, 0.0], None), (9, None, None), (10, [], None), (11, [0.0, -0.0], None), (12, [1.0, None], None), (13, [nan, 1.0], None), (14, [inf, 1.0], None),
        (15, [1.0, 0.0, 0.0], None), (16, [1.0], None), (None, [1.0, 0.0], None), (20, [1e300, 1e299], None), (21, [1e-300, 1e-301], None),
    ]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in forest.near_duplicates(spark.createDataFrame(rows, KINDS)).collect()), key=str)
    linked = [5, 3, 4, 7, 7, 20, 21]
    wanted = [(i, 6, 3, i == 3) for i in linked] + [(i, 0, i, True) for i in (8, 9, 10, 11, 12, 13, 14, 15, 16)] + [(None, 0, None, True)]
    assert got == sorted(wanted, key=str)


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    df = forest.near_duplicates(spark.createDataFrame([(1, [0.5, 0.5], None)][:n], KINDS))
    assert [tuple(r) for r in df.collect()] == [(1, 0, 1, True)][:n]


def test_a_third_of_all_rows_is_one_vector(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [0.6, 0.8, 0.0], None) for i in range(3000)] + [(3000 + i, rng.standard_normal(3).tolist(), None) for i in range(50)]
    got = {r["vec_id"]: r for r in forest.near_duplicates(spark.createDataFrame(rows, KINDS)).collect()}
    assert all(got[i]["component_id"] == 0 and got[i]["n_links"] == got[0]["n_links"] >= 2999 for i in range(3000))
