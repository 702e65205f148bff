"""The automaton against looking for each key in each text."""

import random

import pytest
from pyspark.sql import functions as F

from stratalith.functions import text as T
from stratalith.operators import dictionary, ranking
from stratalith.search_queries import FAILURES, LABELS


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_all_keys_of_all_texts(spark, monkeypatch, most):
    monkeypatch.setattr(dictionary, "MOST_BYTES", most)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab é数\n") for _ in range(n))
    texts = [(i, word(rng.randint(0, 60)), "x") for i in range(200)] + [(900, None, "x"), (901, "", "x"), (902, "ab" * 50_000, "x")]
    keys = sorted({word(rng.randint(1, 4)) for _ in range(40)} | {"", "ab", "b数"}) + [None, "ab"]
    got = dictionary.found_in(spark.createDataFrame(texts, "id long, text string, key2 string"), spark.createDataFrame([(k,) for k in keys], "key string"))
    assert got.columns == ["id", "key2", "key"]
    found = [(r["id"], r["key"]) for r in got.collect()]
    assert sorted(found) == sorted({(i, k) for i, t, _ in texts for k in keys if t is not None and k is not None and k in t})


def test_empty(spark):
    none = spark.createDataFrame([], "id long, text string")
    some = spark.createDataFrame([(1, "a")], none.schema)
    assert dictionary.found_in(none, spark.createDataFrame([("a",)], "key string")).count() == 0
    assert dictionary.found_in(some, spark.createDataFrame([], "key string")).count() == 0
    assert [r["labels"] for r in dictionary.labelled(some, []).collect()] == [[]]


def test_labels_equal_the_column_functions(spark):
    texts = ["Http request to the DB", "Error 404", "rate limit hit", "AUTH failed", "bad json", "Json", "nothing", "", None, "Internal Server Error", "internal server error", "timeout then 500", "Caffeine builder"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["labels"] for r in dictionary.labelled(df, [*LABELS, *FAILURES]).collect()}
    wanted = df.select("id", T.concept_tags(F.lit(""), F.col("text"), F.lit("x")).alias("tags"), T.error_class(F.col("text")).alias("kind")).collect()
    kinds = {n for n, _, _ in FAILURES}
    for r in wanted:
        if texts[r["id"]] is not None:
            assert [x for x in got[r["id"]] if x not in kinds] == [t for t in r["tags"] if t != "exception"]
            assert next((x for x in got[r["id"]] if x in kinds), "other") == r["kind"]
    assert got[8] == []


def test_expansion_of_a_table_equals_single_questions(spark):
    asked = ["how does the redis cache expire", "数据库 连接池", "a page of results", "nothing to see", "get user"]
    synonyms = spark.createDataFrame([(k, v) for k, values in ranking.SYNONYMS.items() for v in values], "key string, value string")
    got = {}
    for r in ranking.expanded_texts(spark.createDataFrame(list(enumerate(asked)), "id long, text string"), synonyms).collect():
        got.setdefault(r["id"], set()).add(r["concept"])
    assert {i: got.get(i, set()) for i in range(len(asked))} == {i: set(ranking.Question.of(t).expanded) for i, t in enumerate(asked)}
