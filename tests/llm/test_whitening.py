"""Operator 11 against numpy's own eigenvectors."""

import numpy as np
import pytest

from stratalith.llm import whitening
from stratalith.llm.queries import QUERIES

KINDS = "vec_id long, embedding array<double>, __bad string"


def brute(vectors, components=32):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    v = np.cov(x.T, bias=True).reshape(x.shape[1], -1)
    values, found = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    return x, values[order], found[:, order], np.trace(v)


def test_query_equals_brute_force(spark, sf, tmp_path):
    rows = [tuple(r) for r in QUERIES["op11_embedding_whitening"](spark, sf).collect()]
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x, values, found, trace = brute([r["embedding"] for r in table])
    n, k = x.shape[0], len(values)
    assert len(rows) == n * k and {r[1] for r in rows} == set(range(1, k + 1))
    of = {(r[0], r[1]): r for r in rows}
    exact = [int(s) for s in x.sum(axis=0)]
    places = {r["vec_id"]: i for i, r in enumerate(table)}
    got = np.array([[of[v, c + 1][4] for c in range(k)] for v in places])
    wanted = (x - x.mean(axis=0)) @ found / np.sqrt(values)
    assert np.abs(np.abs(got) - np.abs(wanted)).max() < 1e-6
    assert all(abs(of[0, c + 1][5] / (values[c] / trace) - 1) < 1e-9 for c in range(k))
    assert {r[2] for r in rows} == {n} and {r[6] for r in rows} == {rows[0][6]} and 0 <= rows[0][6] < 1e-9
    for v in list(places)[:50]:
        assert of[v, 1][3] == sum((n * int(a) - s) ** 2 for a, s in zip(x[places[v]], exact, strict=True))


@pytest.mark.parametrize("kind", ["plain", "equal", "flat", "few", "spread", "wide"])
def test_intervals_and_filter(kind):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((400, 40))
    if kind == "equal":
        a = np.vstack([np.eye(40), -np.eye(40)]) * 3
    if kind == "flat":
        a[:, 7:] = a[:, :1] * 2
    if kind == "few":
        a = a[:5]
    if kind == "spread":
        a *= np.logspace(0, -4, 40)
    if kind == "wide":
        a = rng.standard_normal((600, 150))
    a -= a.mean(axis=0)
    v = a.T @ a / len(a)
    cut = whitening.intervals(v, 32)
    pairs = [whitening.feast(v, *c) for c in cut]
    values, found = np.concatenate([p[0] for p in pairs]), np.vstack([p[1] for p in pairs])
    true = np.linalg.eigvalsh(v)[::-1]
    rank = int((true > whitening.NOTHING * np.trace(v)).sum())
    assert len(values) >= min(32, rank)
    assert np.abs(values - true[: len(values)]).max() < 1e-12 * true[0]
    assert np.abs(found @ found.T - np.eye(len(found))).max() < 1e-6
    for shift in np.quantile(true, [0.1, 0.5, 0.9]) + 1e-3 * true[0]:
        assert whitening.above(v, shift) == (true > shift).sum()


def test_missed_eigenvalues_are_an_error():
    with pytest.raises(ArithmeticError):
        whitening.feast(np.diag([1.0, 2.0, 3.0]), 1.5, 2.5, 2)


def test_odd_rows(spark):
    good = [[0.1, 0.5, -0.3], [0.7, 0.2, 0.9], [0.7, 0.2, 0.9], [-0.4, 0.0, 0.1]]
    odd = [None, [], [0.1, None, 0.2], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 1.0], [0.5, 0.5]]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(None, good[0], None), (3, [0.3, 0.3, 0.3], None)] + [(9, v, None) for v in odd]
    df = spark.createDataFrame(rows, KINDS)
    model = whitening.fit(df)
    assert model.n == 6 and len(model.eigenvalues) == 3 and model.identity_error < 1e-12
    got = whitening.whitened(df, model).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["0", "1", "2", "3", "3", "None"]
    w = np.array([r["whitened"] for r in got])
    assert np.abs(w.T @ w / 6 - np.eye(3)).max() < 1e-12


def test_no_variance_empty_and_huge(spark, tmp_path):
    same = spark.createDataFrame([(i, [0.5, 0.25], None) for i in range(4)], KINDS)
    model = whitening.fit(same)
    assert model.n == 4 and len(model.eigenvalues) == 0
    assert [tuple(r) for r in whitening.whitened(same, model).select("deviation", "whitened").distinct().collect()] == [(0, [])]
    spark.createDataFrame([], KINDS).write.parquet(f"{tmp_path}/embeddings.parquet")
    empty = QUERIES["op11_embedding_whitening"](spark, str(tmp_path))
    assert empty.count() == 0 and len(empty.columns) == 7
    huge = spark.createDataFrame([(0, [1e300, 1.0], None), (1, [-1e300, 2.0], None), (2, [0.0, 3.0], None)], KINDS)
    model = whitening.fit(huge)
    rows = whitening.whitened(huge, model).collect()
    assert len(rows) == 3 and model.sums[1] == 3_000_384 and {r["vec_id"]: r["deviation"] is None for r in rows} == {0: True, 1: True, 2: False}
    large = spark.createDataFrame([(0, [1e15], None), (1, [-1e15], None)], KINDS)
    assert {r["deviation"] for r in whitening.whitened(large, whitening.fit(large)).collect()} == {(2 * 64 * 10**15) ** 2}
