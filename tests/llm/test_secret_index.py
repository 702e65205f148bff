import re
import time

from pyspark.sql import functions as F

from stratalith.llm import secrets


def test_index_and_lookups_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    index = secrets.postings(docs)
    keyed = {r.key: r.text.lower() for r in docs.where("text IS NOT NULL").select(secrets.row_key().alias("key"), "text").collect()}
    some = {k: t for k, t in keyed.items() if len(t) < 3000}
    got = {(r.key, r.gram) for r in index.where(F.col("key").isin(list(some)[:20])).collect()}
    want = {(k, t[i : i + 3]) for k, t in list(some.items())[:20] for i in range(len(t) - 2)}
    assert got == want
    rules = (*secrets.RULES, secrets.Rule("other", "(?:and the|ethe)[a-z]+ing"))
    bits = {r.key: r.rules for r in secrets.candidates(index, rules).collect()}
    for k, rule in enumerate(rules):
        query = secrets.trigram_query(rule.pattern)
        holds = {key for key, t in keyed.items() if query and all(any(all(g in t for g in x) for x in clause) for clause in query)}
        assert {key for key, b in bits.items() if b >> k & 1} == holds
        assert not query or {key for key, t in keyed.items() if re.search(rule.pattern, t)} <= holds


def test_trigrams_over_chunk_borders(spark):
    text = "x" * (secrets.CHUNK - 1) + "akia" + "B" * 16
    docs = spark.createDataFrame([(1, text), (2, "ab"), (3, ""), (4, None), (5, "🙂ab")], "doc_id long, text string")
    grams = {(r.key, r.gram) for r in secrets.postings(docs).collect()}
    assert len({k for k, _ in grams}) == 2 and {"xak", "aki", "kia", "iab", "🙂ab"} <= {g for _, g in grams}


def test_many_matches_in_one_text(spark):
    n = 100_000
    text = "é token=abcdef%05d " * n % tuple(range(n))
    rows = spark.createDataFrame([(1, text), (2, "secret: " + "y" * 3_000_000)], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in secrets.scanned(rows).select("row.doc_id", "spans").collect()}
    assert [(s.start, s.end) for s in got[1].spans] == [(m.start(), m.end()) for m in re.finditer(r"token=\w+", text)]
    assert [(s.start, s.end) for s in got[2].spans] == [(0, 3_000_008)]
    clean = {r.doc_id: r.text for r in secrets.redacted(rows).collect()}
    assert clean[1] == re.sub(r"token=\w+", "[ASSIGN]", text) and clean[2] == "[ASSIGN]"
    assert time.monotonic() - began < 90


def test_broken_bytes(spark):
    rows = spark.sql("SELECT 1L AS doc_id, CAST(X'FF20746F6B656E3D616263646566C3' AS STRING) AS text")
    assert [s.kind for s in secrets.scanned(rows).first().spans] == ["assign"]
