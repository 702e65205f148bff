from stratalith.llm import decontamination

PASSAGE = "one two three four five six seven eight nine ten"


def test_each_row_is_judged_by_its_own_text(spark):
    kept = [(None, "a clean text", "x"), (None, None, "x"), (None, "", "x"), (1, "other words", "x"), (2, "as clean as can be", "x"), (3, None, "x"), (2, "as clean as can be", "x")]
    gone = [(None, f"say {PASSAGE}", "y"), (1, f"{PASSAGE} end", "y"), (3, PASSAGE.upper(), "y"), (3, PASSAGE.upper(), "y")]
    docs = spark.createDataFrame(kept + gone, "doc_id long, text string, __bad string")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    got = decontamination.clean(docs, items)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, kept))
