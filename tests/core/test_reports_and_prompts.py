import json
import random

from pyspark.sql import functions as F

from stratalith.functions import text as T
from stratalith.operators import graph, ranking, relational
from stratalith.plans import analysis, knowledge_base, reports, settings
from stratalith.sources import files


def test_batches_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(relational, "STRETCH", 20)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", "c", None]), i, rng.choice([0, 1, 5, 90, 2000, 5000])) for i in range(300)]
    rows += [("d", i, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, i long, c long")
    want = {}
    for k in {r[0] for r in rows}:
        batch = n = spent = 0
        for _, i, c in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if n and (n >= 15 or spent + c > 4000):
                batch, n, spent = batch + 1, 0, 0
            n, spent = n + 1, spent + c
            want[k, i] = batch
    got = relational.greedy_batches(df, ["k"], ["i"], "c", 15, 4000).collect()
    assert len(got) == len(rows) and {(r.k, r.i): r.batch for r in got} == want
    assert relational.greedy_batches(df.limit(0), ["k"], ["i"], "c", 15, 4000).count() == 0
    fixed = {(r.k, r.i): r.batch for r in relational.fixed_batches(df.select("k", "i"), ["k"], ["i"], 5).collect()}
    assert fixed == {(k, i): j // 5 for k in {r[0] for r in rows} for j, i in enumerate(sorted(r[1] for r in rows if r[0] == k))}


def test_run_over_a_project(spark):
    functions = spark.createDataFrame([("m.py", f"f{i}", i, None if i % 4 == 0 else f"explain f{i}") for i in range(40)], "path string, name string, start_line int, prompt string")
    classes = spark.createDataFrame([("m.py", f"C{i}", i, f"explain C{i}") for i in range(10)], "path string, name string, start_line int, prompt string")
    modules = spark.createDataFrame([(f"m{i}.py", f"explain m{i}") for i in range(7)], "path string, prompt string")

    def completer(prompts):
        if any("explain C9" in p for p in prompts):
            raise OSError
        return [json.dumps({p.split(" ")[1].upper() if i % 2 else p.split(" ")[1]: f"about {p}" for i, p in enumerate(x.split("\n---\n"))}) for x in prompts]

    out = analysis.analysed_project(functions, classes, modules, completer)
    told = {r.name: r.summary for r in out["functions"].collect()}
    assert len(told) == 40 and told["f1"] == "about explain f1" and told["f3"] == "about explain f3" and told["f4"] is None
    told = {r.name: r.summary for r in out["classes"].collect()}
    assert len(told) == 10 and told["C9"] == "C9 (no summary)"
    assert {r.summary for r in out["modules"].collect()} == {f"about explain m{i}" for i in range(7)}
    assert "m3.py: 0 classes, 0 functions" in out["architecture"].first().prompt and "## m3.py\nabout explain m3" in out["business"].first().prompt


def test_assignment_within_batches(spark):
    rows = spark.createDataFrame([(1, "a/x.py", 1), (1, "b/y.py", 2), (2, "a/x.py", 1), (2, "c/z.py", 2)], "batch int, path string, i int")
    answers = spark.createDataFrame([(1, "a/x.py", "x", 1), (1, "y.py", "y", 2), (2, "nothing", "first", 1)], "batch int, key string, summary string, place int")
    got = {(r.batch, r.path): r.summary for r in analysis.assigned(rows, answers, "path", "i", ["batch"], path=True).collect()}
    assert got == {(1, "a/x.py"): "x", (1, "b/y.py"): "y", (2, "a/x.py"): "first", (2, "c/z.py"): "c/z.py (no summary)"}


def test_business_text_is_asked_for_once(spark):
    metadata = spark.createDataFrame([], "key string, value string, updated timestamp")
    prompt = spark.createDataFrame([("p",)], "prompt string")
    first, after = analysis.cached_text(metadata, "business", prompt, lambda ps: ["told"])
    assert (first.first().value, first.first().from_cache) == ("told", False)
    kept = spark.createDataFrame(after.collect(), metadata.schema)
    again, _ = analysis.cached_text(kept, "business", prompt, lambda ps: ["other"])
    assert (again.first().value, again.first().from_cache) == ("told", True)
    assert analysis.cached_text(kept, "business", prompt, lambda ps: ["other"], force=True)[0].first().value == "other"


def test_relations_and_bases_in_context(spark):
    classes = spark.createDataFrame([("a.py", "A", 1, ["B", "X"]), ("b.py", "B", 1, []), ("b.py", "C", 2, ["B"]), ("c.py", "B", 9, [])], "path string, name string, pos int, bases array<string>")
    got = {tuple(r) for r in analysis.class_relations(classes).collect()}
    assert got == {("a.py", "A", "base", 0, "B", "b.py"), ("b.py", "C", "base", 0, "B", "b.py"), ("b.py", "B", "subclass", 0, "A", "a.py"), ("b.py", "B", "subclass", 0, "C", "b.py"), ("c.py", "B", "subclass", 0, "A", "a.py"), ("c.py", "B", "subclass", 0, "C", "b.py")}
    functions = spark.createDataFrame([("m:f", "A", "code f")], "id string, class_id string, content string")
    bases = spark.createDataFrame([("A", "B", "class B")], "class_id string, id string, content string")
    rows = analysis.context(functions, spark.createDataFrame([], "src string, dst string"), "m:f", spark.createDataFrame([], "id string, content string, score double"), bases=bases).collect()
    assert [(r.id, r.kind, r.priority) for r in rows] == [("m:f", "target", 100.0), ("B", "base", 70.0)]


def test_paths_and_settings(spark, tmp_path):
    modules = spark.createDataFrame([("src\\a.py",), ("lib/a.py",)], "relative_path string")
    assert files.module_at(modules, "/top/src/a.py", "/top").first().relative_path == "src\\a.py" and files.module_at(modules, "a.py").isEmpty()
    assert files.resolved(modules, "src/a.py").first().relative_path == "src\\a.py" and files.resolved(modules, "x/a.py").first().relative_path == "lib/a.py"
    match = modules.select(files.matches_path(F.col("relative_path"), F.lit("src/a")).alias("a"), files.matches_path(F.col("relative_path"), F.lit("q/a.py")).alias("b"), files.matches_path(F.col("relative_path"), F.lit("")).alias("c")).collect()
    assert [tuple(r) for r in match] == [(False, True, True), (False, True, True)]
    s = settings.loaded('{"scanner": {"max_file_size": 5, "other": 1}, "llm": {"model": "m"}}', {"LLM_API_KEY": "k", "LLM_MODEL": "n"})
    assert (s.scanner.max_file_size, s.llm.model, s.llm.api_key) == (5, "m", "k") and "vendor*.js" in s.scanner.exclude_files
    base = knowledge_base.KnowledgeBase(spark, str(tmp_path), "p")
    for i in range(4):
        base.write("dependencies", spark.createDataFrame([(str(i), "x")], "path string, depends_on string"))
    (tmp_path / "p" / "dependencies" / "v-00000005").mkdir()  # what a failed job leaves
    assert base.versions("dependencies") == ["v-00000003", "v-00000004"] and base.read("dependencies").first().path == "3"
    assert knowledge_base.projects(spark, str(tmp_path), "P") == ["p"] and knowledge_base.projects(spark, str(tmp_path), "q") == []


def test_small_texts_and_split_report(spark, tmp_path):
    one = spark.createDataFrame([("r'''doc's text'''", "what is a page", "abcdef", ["x", 'y"'])], "d string, q string, s string, a array<string>")
    r = one.select(T.docstring(F.col("d")).alias("d"), T.question_words(F.col("q")).alias("q"), T.display(F.col("s"), 4).alias("s"), T.display(F.lit("a"), 3).alias("t"), T.json_text(F.col("a")).alias("a"), T.rough_tokens(F.col("s")).alias("n")).first()
    assert (r.d, r.q, r.s, r.t, r.a, r.n) == ("doc's text", ["what", "is", "page"], "abcd", "a  ", '["x","y\\""]', 4)
    lines = spark.range(300).select(F.col("id").alias("place"), F.concat(F.lit("l"), "id").alias("line"))
    reports.write_split({"00_overview": lines, "01_rest": lines.limit(2)}, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out" / "index")).collect()] == ["- [00_overview](00_overview)", "- [01_rest](01_rest)"]
    parts = sorted((tmp_path / "out" / "00_overview").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split() == [f"l{i}" for i in range(300)]
    assert "list" in ranking.Question.of("分页 怎么做").expanded or "pagehelper" in ranking.Question.of("分页 怎么做").expanded
    pairs = graph.contained(spark.createDataFrame([("a",), ("ab",), ("abc",), ("zz",)], "part string"), spark.createDataFrame([("xabcx",), ("b",), ("",)], "whole string"))
    assert {tuple(r) for r in pairs.collect()} == {("a", "xabcx"), ("ab", "xabcx"), ("abc", "xabcx")}
