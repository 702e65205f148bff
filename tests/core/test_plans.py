import pytest
from pyspark.sql import functions as F

from stratalith.plans import analysis, knowledge_base
from test_sources import FILES


def write(top, names):
    for name in names:
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(FILES[name].encode("latin-1"))


def test_build_twice(spark, tmp_path):
    source = tmp_path / "source"
    write(source, ["src/SqlMapper.cs", "src/shop/order.py", "src/Shop.java"])
    base = knowledge_base.KnowledgeBase(spark, str(tmp_path / "kb"), "shop")
    assert base.build(str(source)) == {"changed": 3, "gone": 0}
    assert base.build(str(source)) == {"changed": 0, "gone": 0}
    one = base.overview().first()
    assert (one.modules, one.classes, one.functions) == (3, 4, 7)
    assert {tuple(r) for r in base.read("edges").collect()} == {("src/shop/order.py:main", "src/shop/order.py:OrderProcessor.send")}
    detail = base.class_detail("SqlMapper").first()
    assert detail.methods[0].method.content.strip().startswith("public static IEnumerable<T> Query<T>")
    assert [r.name for r in base.find("order").collect()] == ["OrderProcessor"]
    assert "OrderProcessor" in {r.name for r in base.search("order processor total").collect()}
    (source / "src/Shop.java").unlink()
    (source / "src/shop/order.py").write_text("def other():\n    return 1\n")
    write(source, ["web/app.ts"])
    assert base.build(str(source)) == {"changed": 2, "gone": 1}
    assert {r.relative_path for r in base.read("modules").collect()} == {"src/SqlMapper.cs", "src/shop/order.py", "web/app.ts"}
    assert {r.name for r in base.read("functions").where("relative_path = 'src/shop/order.py'").collect()} == {"other"}
    assert knowledge_base.projects(spark, str(tmp_path / "kb")) == ["shop"]


def test_a_failed_build_is_repeated(spark, tmp_path, monkeypatch):
    source = tmp_path / "source"
    write(source, ["src/Shop.java"])
    base = knowledge_base.KnowledgeBase(spark, str(tmp_path / "kb"), "shop")
    link = knowledge_base.KnowledgeBase.link
    monkeypatch.setattr(knowledge_base.KnowledgeBase, "link", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        base.build(str(source))
    monkeypatch.setattr(knowledge_base.KnowledgeBase, "link", link)
    assert base.build(str(source)) == {"changed": 1, "gone": 0}
    assert base.build(str(source)) == {"changed": 0, "gone": 0}
    one = base.overview().first()
    assert (one.modules, one.classes, one.functions) == (1, 2, 3) and base.read("files").count() == 1


def test_analysis_cache(spark):
    cache = spark.createDataFrame([], "target_type string, target_name string, path string, code_hash string, result string, manually_corrected boolean, updated timestamp")
    targets = spark.createDataFrame([("function", "f", "a.py", "x = 1", "p1"), ("function", "g", "a.py", "y = 1", "p2")], "target_type string, target_name string, path string, code string, prompt string")
    first, after = analysis.analysed(targets, cache, analysis.deterministic)
    assert {r.from_cache for r in first.collect()} == {False}
    kept = spark.createDataFrame(after.collect(), cache.schema)
    changed = targets.withColumn("code", F.when(F.col("target_name") == "g", "z = 2").otherwise(F.col("code")))
    again, _ = analysis.analysed(changed, kept, analysis.deterministic)
    assert {r.target_name: r.from_cache for r in again.collect()} == {"f": True, "g": False}
    assert {r.from_cache for r in analysis.analysed(targets, kept, analysis.deterministic, force=True)[0].collect()} == {False}


def test_prompts_and_summaries(spark):
    functions = spark.createDataFrame([("get", 1, 90, ["a", "b"], "x", None), ("work", 1, 90, ["a", "b"], "body", None)], "name string, start_line int, end_line int, parameters array<string>, content string, summary string")
    rows = {r.name: r for r in analysis.function_prompts(functions).collect()}
    assert rows["get"].summary == "get (simple)" and rows["get"].prompt is None and "body" in rows["work"].prompt
    answers = spark.createDataFrame([("Work", "does work", 7), ("other", "by place", 0)], "key string, summary string, place int")
    named = spark.createDataFrame([("work", 5), ("gone", 0), ("none", 9)], "name string, i int")
    assert {r.name: r.summary for r in analysis.assigned(named, answers, "name", "i").collect()} == {"work": "does work", "gone": "by place", "none": "none (no summary)"}
    broken = analysis.completed(functions.withColumn("prompt", F.lit("p")), "prompt", lambda prompts: 1 / 0)
    assert {r.answer for r in broken.collect()} == {""}
    page = analysis.paged(named, [F.col("name")], 2, 2)
    assert page["total"] == 3 and page["pages"] == 2 and [r["name"] for r in page["items"]] == ["work"]


def test_context(spark):
    functions = spark.createDataFrame([("m:f", "A", "code f"), ("m:g", "A", "code g"), ("m:h", "B", "code h")], "id string, class_id string, content string")
    edges = spark.createDataFrame([("m:f", "m:h")], "src string, dst string")
    found = spark.createDataFrame([("m:h", "code h", 400.0), ("m:z", "code z", 10.0)], "id string, content string, score double")
    rows = analysis.context(functions, edges, "m:f", found)
    assert [(r.id, r.kind) for r in rows.orderBy(F.desc("priority")).collect()] == [("m:h", "search"), ("m:f", "target"), ("m:g", "sibling"), ("m:z", "search")]
    assert analysis.context_text(rows).first().text.startswith("### m:h (search)\ncode h\n\n### m:f (target)")
