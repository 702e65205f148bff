"""Proximity within documents against looking at every start, with the neighbours in one block."""

import random

import pytest

from stratalith.llm import decontamination


def brute(docs, items, width, slop):
    found = {}
    for doc_id, text in docs:
        words = (text or "").split()
        covered, names = set(), set()
        for item_id, item in items:
            terms = item.split()
            n = min(width, len(terms))
            for i in range(len(terms) - n + 1):
                window = terms[i : i + n]
                for start in range(len(words)):
                    if n and all(w in words[max(0, start + o - slop) : max(0, start + o + slop + 1)] for o, w in enumerate(window)):
                        covered |= set(range(max(0, start), min(len(words), start + n)))
                        names.add(item_id)
        found[doc_id] = (len(covered), sorted(names))
    return found


def asked(spark, docs, items, slop):
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame(items, "item_id string, text string")
    return {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontamination.contamination(d, b, slop=slop).collect()}


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_random_texts_in_one_block(spark, slop):
    rng = random.Random(slop)
    word = lambda: rng.choice("abcdef")
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 14)))) for i in range(40)]
    items = [(f"i{k}", " ".join(word() for _ in range(rng.choice([2, 3, 5, 10, 12])))) for k in range(12)]
    assert asked(spark, docs, items, slop) == brute(docs, items, decontamination.WINDOW, slop)


def test_a_phrase_over_two_documents_is_none(spark):
    words = [f"w{i}" for i in range(1, 11)]
    docs = [(1, " ".join(words[:9])), (2, "w10 foo bar")]
    assert asked(spark, docs, [("x", " ".join(words))], 2) == {1: (0, []), 2: (0, [])}


def test_matches_at_the_ends(spark):
    docs = [(1, "z z r x x x x x x x")]
    items = [("x", "r x x x x x x x x x")]
    assert asked(spark, docs, items, 2) == brute(docs, items, 10, 2)
