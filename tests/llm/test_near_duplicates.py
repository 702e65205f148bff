import random

import numpy as np

from stratalith.llm import near_duplicates
from stratalith.llm.queries import op5_minhash_near_dedup


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    """rows: (doc_id, text). The least doc_id reachable from each."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    pairs = {(a, b) for at in by.values() for a in at for b in at if a < b}
    for a, b in pairs:
        (i, s), (j, t) = sets[a], sets[b]
        if 100 * len(s & t) >= 75 * len(s | t):
            i, j = find(i), find(j)
            parent[max(i, j)] = min(i, j)
    return {i: (len(s), find(i)) for i, s in sets}


def test_equals_brute_force(spark, sf, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_minhash_near_dedup(spark, sf).collect()}
    want = brute_components([(d["doc_id"], d["text"]) for d in documents])
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_chains_and_threshold_cases(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 7, 30, 120, 400]))]
        for _ in range(rng.choice([2, 5, 25])):
            words = list(words)
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            rows.append((n, " ".join(words)))
            n += 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_odd_rows(spark, odd_documents):
    rows = near_duplicates.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.kept for r in rows if r.doc_id is None or r.n_shingles == 0)
    stay = near_duplicates.deduplicated(odd_documents)
    assert stay.columns == odd_documents.columns
    assert stay.where("doc_id = 3").count() == 1 and stay.where("doc_id IS NULL").count() == 2
    assert near_duplicates.near_duplicates(odd_documents.limit(0)).count() == 0


def test_registers_hold_least_hash_of_bucket():
    rng = np.random.default_rng(1)
    s = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    got = near_duplicates.registers(s)
    for bucket in range(128):
        rest = [int(x) & (2**57 - 1) for x in s if int(x) >> 57 == bucket]
        if not rest:
            assert got[bucket] in got[[int(x) >> 57 for x in s]]
            continue
        bits = f"{min(rest) >> 4:053b}"
        zeros = len(bits) - len(bits.lstrip("0"))
        assert got[bucket] == 1 + (zeros << 10) + int((bits[zeros + 1 :] + "0" * 60)[:10], 2)


def test_crowded_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "PER_TASK", 2)
    monkeypatch.setattr(near_duplicates, "SHINGLES_PER_TASK", 3)
    monkeypatch.setattr(near_duplicates, "BROADCAST_ROWS", 1)
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for n in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 3, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((n, " ".join(words) if n % 10 else ""))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df).collect()}
    assert got == brute_components(rows)
    many = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 0), (3, 0), (None, 5)], "k long, v long")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    joined = near_duplicates.dealt(many, ["k"], one, ["id"], near_duplicates.crowded(many, ["k"]), how="left").select("k", "v", "x").collect()
    assert sorted(map(str, map(tuple, joined))) == sorted(map(str, [(1, i, "a") for i in range(9)] + [(2, 0, "b"), (3, 0, None), (None, 5, None)]))


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(3, long, "x"), (5, long, "x"), (5, "an own text of some words here", "x"), (None, long, "x"), (None, "a b c d e f", "x"), (None, "a b c d e f", "x"), (7, "", "x"), (7, None, "x"), (3, long, "x")]
    stay = near_duplicates.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, n string")).collect()
    assert sorted(map(str, map(tuple, stay))) == sorted(map(str, [(3, long, "x"), (5, "an own text of some words here", "x"), (None, "a b c d e f", "x"), (7, "", "x"), (7, None, "x")]))
