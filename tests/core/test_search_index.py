"""Stored indexes against scans, on random names and questions."""

import random

import pytest

from stratalith.operators import ranking, search_index
from stratalith.search_queries import scanned_search

PARTS = ["user", "order", "cache", "db", "page", "get", "find", "log", "x", "service", "User", "Repo"]


def snippets(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(["", "."]).join(rng.choice(PARTS) for _ in range(rng.randint(1, 3)))
        words = " ".join(rng.choice(PARTS + ["cached", "rest", "select", "error"]) for _ in range(rng.randint(0, 5)))
        start = rng.randint(1, 9)
        rows.append((rng.choice(["class", "function", "module"]), name, f"p{i % 50}.py", start, start + rng.choice([5, 20, 60, 300]), words, i))
    return built(spark, rows)


def built(spark, rows):
    found = ranking.build_index(spark.createDataFrame(rows, "kind string, name string, path string, start_line int, end_line int, signature string, pos long"))
    return spark.createDataFrame(found.collect(), found.schema)


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 400, 8), (2, 60, 128), (3, 3, 128)])
def test_answers_equal_scans(spark, monkeypatch, seed, n, block):
    monkeypatch.setattr(search_index, "BLOCK", block)
    index = snippets(spark, seed, n)
    rng = random.Random(seed)
    texts = ["user service", "redis cache of orders", "zzz", "the page", "db log error", "getUser", ""] + [" ".join(rng.sample(PARTS, 3)) for _ in range(4)]
    questions = [(t + str(i), ranking.Question.of(t)) for i, t in enumerate(texts)]
    rows = spark.createDataFrame([(qid, list(q.words), list(q.expanded)) for qid, q in questions], "qid string, words array<string>, expanded array<string>")
    for number, budget in ((8, 3000), (3, 10)) if seed == 1 else ((8, 3000),):
        found = search_index.ask(search_index.snippet_index(index), rows, number, budget).collect()
        got = {qid: [] for qid, _ in questions}
        for r in sorted(found, key=lambda r: (r["qid"], r["rank"])):
            got[r["qid"]].append((r["key"], round(r["score"], 6)))
        assert got == scanned_search(index, questions, number, budget)


def test_closed_blocks_are_not_opened(spark):
    """A hundred good names leave the lists of words alone: they would add nothing."""
    rows = [("class", f"user{i}", f"a{i}", 1, 90, "other", i) for i in range(100)] + [("module", f"z{i}", f"b{i}", 1, 2, "user", 1000 + i) for i in range(500)]
    stored = search_index.snippet_index(built(spark, rows))
    question = spark.createDataFrame([("q", ["user"], [])], "qid string, words array<string>, expanded array<string>")
    got = search_index.ask(stored, question).collect()
    assert len(got) == 8 and all(r["name"].startswith("user") for r in got)
    least = min(r["score"] for r in got)
    assert stored.read("postings").where(f"term = 'user' AND 5 * top_boost + top_bonus >= {least}").isEmpty()


def test_equal_snippets_are_held_up_to_what_is_asked(spark):
    """Two thousand snippets of few shapes: the index holds the first of each, and answers as a scan of all does."""
    rows = [(("class", "function", "module")[i % 3], ("userService", "order", "zz")[i // 3 % 3], f"p{i}.py", 1, (10, 90)[i // 9 % 2], ("select cache", "page", "")[i // 18 % 3], 5000 - i) for i in range(2000)]
    every = built(spark, rows)
    index = search_index.snippet_index(every, most=8)
    assert index.read("by_name").count() <= 3 * 3 * 2 * 3 * 8
    texts = ["user", "cache", "page of zz", "nothing else", "order select"]
    questions = [(t, ranking.Question.of(t)) for t in texts]
    asked = spark.createDataFrame([(qid, list(q.words), list(q.expanded)) for qid, q in questions], "qid string, words array<string>, expanded array<string>")
    for number in (8, 3):
        got = {qid: [] for qid, _ in questions}
        for r in sorted(search_index.ask(index, asked, number, 3000).collect(), key=lambda r: (r["qid"], r["rank"])):
            got[r["qid"]].append((r["key"], round(r["score"], 6)))
        assert got == scanned_search(every, questions, number, 3000)
    with pytest.raises(ValueError, match="most=9"):
        search_index.ask(index, asked, 9)


def test_hits_by_part_of_a_word(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcAé_ .") for _ in range(rng.randint(0, 9))) for _ in range(600)] + [None, "", "aaa" * 50]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, title string")
    words = sorted({n[i : i + k].lower() for n in names if n for i in range(3) for k in (1, 2, 3, 4, 6)} - {""})[:120] + ["nothere", "%", "__"]
    index = search_index.name_index(rows, "title")
    found = {}
    for r in index.hits(spark.createDataFrame([(w,) for w in [*words, None, ""]], "word string"), ["id"], 4).collect():
        found.setdefault(r["word"], []).append(r["id"])
    wanted = {w: [i for i, n in enumerate(names) if n is not None and w in n.lower()][:4] for w in words}
    assert {w: sorted(v) for w, v in found.items()} == {w: v for w, v in wanted.items() if v}


def test_a_list_is_looked_up_by_its_gram(spark):
    index = search_index.name_index(spark.createDataFrame([(i, f"name{i:04d}") for i in range(2000)], "id long, name string"), "name")
    words = spark.createDataFrame([("0017",)], "word string")
    assert [r["name"] for r in index.holding(words).collect()] == ["name0017"]
    gram = search_index.probes(words, index.read("frequencies")).first()["gram"]
    assert index.read("names").where(f"gram = '{gram}'").count() <= 30  # not "nam", which all names have


def test_paths(spark):
    paths = [("src/a/Main.java",), ("src/b/main.java",), ("x/Main.java",), ("lib/z.py",), (None,)]
    wanted = [("a\\Main.java",), ("b/ma",), ("",), ("Z.py",), ("lib/z",), ("q/z.py",)]
    got = {(r["wanted"], r["path"]) for r in search_index.paths_matching(spark.createDataFrame(paths, "path string"), spark.createDataFrame(wanted, "wanted string")).collect()}
    every = {("", p) for (p,) in paths if p}
    assert got == every | {("a\\Main.java", "src/a/Main.java"), ("a\\Main.java", "x/Main.java"), ("b/ma", "src/b/main.java"), ("lib/z", "lib/z.py"), ("q/z.py", "lib/z.py")}


def test_empty_tables(spark, tmp_path):
    index = search_index.snippet_index(snippets(spark, 1, 0))
    none = spark.createDataFrame([], "qid string, words array<string>, expanded array<string>")
    one = spark.createDataFrame([("q", ["user"], None)], none.schema)
    assert search_index.ask(index, one).count() == 0
    assert search_index.ask(search_index.snippet_index(snippets(spark, 1, 5)), none).count() == 0
    assert search_index.name_index(spark.createDataFrame([], "id long, name string"), "name").hits(spark.createDataFrame([("a",)], "word string"), ["id"]).count() == 0
