import re

import corpus_pipeline
from stratalith.llm import common, language_id, secrets
from test_chat_and_secrets import PATTERNS
from test_near_duplicates import brute_components
from test_rules_and_decontamination import brute_contamination


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.stored(stage(spark, docs, sf), name)
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.schema.names == before.schema.names
    before, after = (df.collect() for df in kept["language_id"])
    model = language_id.fit(kept["language_id"][0], common.folds(kept["language_id"][0].doc_id, 4) != 2)
    good = {r.doc_id for r in before if model.predict(r.text)[1] >= 0.4}
    assert {r.doc_id for r in after} == good and len(good) > 0.95 * len(before)
    before, after = (df.collect() for df in kept["near_duplicates"])
    assert {r.doc_id for r in after} == {c for _, c in brute_components([(r.doc_id, r.text) for r in before]).values()}
    before, after = (df.collect() for df in kept["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = brute_contamination([r.text for r in before], items)
    assert {r.doc_id for r in after} == {r.doc_id for r, h in zip(before, hit, strict=True) if not h[4]}
    before, after = (df.collect() for df in kept["secrets"])
    new = {r.doc_id: r for r in after}
    assert set(new) == {r.doc_id for r in before}
    for r in before:
        text, some = new[r.doc_id].text, any(re.search(x.pattern, r.text) for x in secrets.RULES)
        assert some or text == r.text
        assert new[r.doc_id].n_chars == len(text) or text == r.text
        assert not any(len(m[g]) >= least for _, p, g, least in PATTERNS for m in re.finditer(p, text))
    before, pieces = (df.collect() for df in kept["packing"])
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before}


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf), name)
    assert docs.count() == 0


def test_odd_documents_through_all_stages(spark, sf, odd_documents):
    """Nulls, empty and long texts, repeated rows, null ids, a clashing column: rows without a letter go with the first
    stage, repeated texts and secrets with theirs, and every row that stays is packed."""
    known = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(900, "token = abcdefghij and some more words of a text", "x"), (None, "token = abcdefghij and some more words of a text", "x")], odd_documents.schema)
    docs = known.withColumn("__bad", known.lang).unionByName(odd_documents.unionByName(extra), allowMissingColumns=True)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf), name)
        assert docs.columns == names
    rows = docs.collect()
    assert all(r.text and any(c.isalpha() for c in r.text) for r in rows)
    assert sum("some more words" in r.text for r in rows) == 1 and not any("abcdefghij" in r.text for r in rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
