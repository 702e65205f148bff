import itertools
import random
import re

from pyspark.sql import functions as F

from stratalith.functions import text as T
from stratalith.operators import graph, incremental, ranking, relational
from stratalith.plans import analysis
from stratalith.streaming import events as stream


def test_call_resolution_cases(spark):
    names = ["a.py:f", "b.py:f", "c.py:f", "d.py:f", "a.py:g", "e.py:h"]
    functions = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "id string, pos int")
    calls = spark.createDataFrame([("a.py:g", "f"), ("e.py:h", "x.f"), ("e.py:h", "g"), ("e.py:h", "unknown")], "caller string, callee string")
    assert sorted(map(tuple, graph.resolve_calls(calls, functions).collect())) == [("a.py:g", "a.py:f"), ("e.py:h", "a.py:f"), ("e.py:h", "a.py:g"), ("e.py:h", "b.py:f"), ("e.py:h", "c.py:f")]


def test_dependencies_by_containment(spark):
    imports = spark.createDataFrame([("m1", "core.scanner"), ("m2", "os"), ("m3", "x.src.core.scanner.py.y"), ("m4", "zz"), ("m5", "")], "path string, module string")
    modules = spark.createDataFrame([("src/core/scanner.py",), ("lib/cosmos.py",), ("a",)], "path string")
    dotted = {p: p.replace("/", ".") for p in ("src/core/scanner.py", "lib/cosmos.py", "a")}
    want = sorted((i, p) for i, m in (r for r in imports.collect()) if m for p, d in dotted.items() if m in d or d in m)
    assert sorted(map(tuple, graph.module_dependencies(imports, modules).collect())) == want


def test_dependencies_are_not_gathered(spark, monkeypatch):
    """Pairs are distinct as they are made, in small cells and by several names; the plan ends with the join that makes them."""
    monkeypatch.setattr(graph, "CELL", 3, raising=False)
    used = [(f"p{i}", m) for i in range(20) for m in ("core", "ore", "a/b.core/f1.py", "none", "f1")[: 1 + i % 5]] + [(None, "core")]
    paths = [f"a/core/f{i}.py" for i in range(20)] + ["core", "f1"]
    imports, modules = spark.createDataFrame(used * 2, "path string, module string"), spark.createDataFrame([(p,) for p in paths * 2], "path string")
    want = sorted({(i, p) for i, m in used for p in paths if m in p.replace("/", ".") or p.replace("/", ".") in m}, key=str)
    found = graph.module_dependencies(imports, modules)
    for rows in (found, graph.depended_by(found)):
        plan = rows._jdf.queryExecution().optimizedPlan()
        while plan.getClass().getSimpleName() == "Project":
            plan = plan.child()
        assert plan.getClass().getSimpleName() == "Join"
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert sorted(((d, p) for p, d in graph.depended_by(found).collect()), key=str) == want


def partitions(rows):
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


def test_replaced_rows_stay_dealt(spark):
    """Many rows of few bytes aren't gathered in few tasks."""
    parents, children = spark.range(0, 900, 1, 1).toDF("k"), spark.range(0, 3600, 1, 1).select((F.col("id") % 1000).alias("k"), F.lit(1).alias("old"))
    new = parents.where("k % 7 = 0")
    after, below = incremental.replaced(parents, children, new, children.where("k = 7").withColumn("old", F.lit(0)), "k")
    assert sorted(r.k for r in after.collect()) == list(range(900))
    assert sorted(map(tuple, below.collect())) == sorted([(i % 1000, 1) for i in range(3600) if i % 1000 % 7 or i % 1000 >= 900] + [(7, 0)] * 4)
    assert partitions(after) == partitions(below) == partitions(after.join(below, "k")) == 4


def test_frequent_names_meet_in_cells(spark, monkeypatch):
    """Few classes with many subclasses make many rows: by all partitions, in small cells, as often as they come."""
    monkeypatch.setattr(relational, "CELL", 3, raising=False)
    left = spark.createDataFrame([("a" if i % 4 else "b", i // 2) for i in range(40)] + [(None, 1), ("z", 1)], "k string, i int").coalesce(1)
    right = spark.createDataFrame([("a" if i % 3 else "b", i // 2) for i in range(31)] + [(None, 1), ("y", 1)], "k string, j int").coalesce(1)
    found = relational.crossed(left, right, "k", ["i"], ["j"])
    assert sorted(map(tuple, found.select("k", "i", "j").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "i", "j").collect()))
    assert partitions(found) == 4
    classes = spark.range(0, 3000, 1, 1).select(F.lit("p").alias("path"), F.concat(F.lit("C"), F.col("id") % 2).alias("name"), F.col("id").alias("pos"), F.array(F.lit("C0"), F.lit("C1")).alias("bases"))
    rows = analysis.class_relations(classes)
    assert rows.groupBy("relation").count().orderBy("relation").collect() == [("base", 6000), ("subclass", 15000)]
    assert partitions(rows.where("relation = 'subclass'")) == 4


def test_texts_expand_in_all_partitions(spark):
    texts = spark.range(0, 400, 1, 1).select("id", F.concat(F.lit("Cats and dog"), F.col("id") % 2).alias("text"))
    synonyms = spark.createDataFrame([("cat", "animal"), ("cat", "pet"), ("bird", "dog1"), ("fish", "x")], "key string, value string")
    found = ranking.expanded_texts(texts, synonyms)
    assert sorted(map(tuple, found.collect())) == sorted((i, c) for i in range(400) for c in ["animal", "pet"] + ["dog1"] * (i % 2))
    assert partitions(found) == 4


def test_cycles_equal_search(spark):
    rng = random.Random(3)
    edges = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(26)}
    want = set()
    for n in (2, 3, 4):
        for path in itertools.permutations(sorted({x for e in edges for x in e}), n):
            if path[0] == min(path) and all((a, b) in edges for a, b in zip(path, (*path[1:], path[0]), strict=True)):
                want.add(path)
    got = {tuple(r.path) for r in graph.cycles(spark.createDataFrame(list(edges), "src string, dst string"), 4).collect()}
    assert got == want


def test_reachable_depths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "c")], "src string, dst string")
    rows = graph.reachable(edges, spark.createDataFrame([("a",)], "id string"), 5).collect()
    assert {(r.node, r.depth) for r in rows} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    chart = graph.mermaid(spark.createDataFrame([("m.py:A.f", "n.py:g")], "src string, dst string")).first().chart
    assert chart == "graph TD\n    A_f --> g"


def test_budget_and_batches(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([5, 4, 9, 1])], "k int, i int, tokens int")
    assert [r.i for r in relational.within_budget(rows, ["k"], [F.col("i")], "tokens", 10, 8).orderBy("i").collect()] == [0, 1]
    many = spark.range(31).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.lit(52).alias("c"))
    batches = [r["count"] for r in relational.greedy_batches(many, ["k"], ["i"], "c", 15, 4000).groupBy("batch").count().orderBy("batch").collect()]
    assert batches == [15, 15, 1]
    for n, keep in ((4, 4), (7, 5), (20, 12)):
        assert relational.top_fraction(spark.range(n), [F.col("id")]).count() == keep


def test_score_case(spark):
    row = spark.createDataFrame([("class", "PageList", "a.py", 1, 101, "", 0)], "kind string, name string, path string, start_line int, end_line int, signature string, pos int")
    index = ranking.build_index(row).withColumn("tags", F.array().cast("array<string>"))
    assert ranking.scored(index, ranking.Question(("page",), ())).first().score == 125
    function = row.withColumns({"kind": F.lit("function"), "name": F.lit("zzz"), "end_line": F.lit(21)})
    assert ranking.scored(ranking.build_index(function), ranking.Question(("page",), ())).first().score == 3
    assert "list" in ranking.Question.of("find the userQuery", ranking.SYNONYMS).expanded and "query" in ranking.Question.of("userQuery").words


def test_texts(spark):
    import hashlib

    df = spark.createDataFrame([("a /* x */ b", "abcdefghijkl"), ("a // x\nb", "abc"), ("", ""), (None, None)], "code string, key string")
    rows = df.select(T.code_hash(F.col("code")).alias("h"), T.masked_key(F.col("key")).alias("k"), T.line_count(F.col("code")).alias("n")).collect()
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert [r.h for r in rows] == [md5("ab"), md5("a//xb"), md5(""), None]
    assert [r.k for r in rows] == ["abcd****ijkl", "***c", "not configured", "not configured"]
    one = spark.createDataFrame([("getUserNameHTTP2", 'say ```json\n{"a": "1"}\n``` end', "src\\core/x.py", "error 404 timeout")], "n string, j string, p string, e string")
    r = one.select(T.camel_parts(F.col("n")).alias("c"), T.lenient_json(F.col("j")).alias("j"), T.base_name(F.col("p")).alias("b"), T.parent_dir(F.col("p")).alias("d"), T.dotted(F.col("p")).alias("t"), T.error_class(F.col("e")).alias("e")).first()
    assert r.c == ["get", "user", "name", "http", "2"] and r.j == {"a": "1"} and (r.b, r.d, r.t, r.e) == ("x.py", "src/core", "src.core.x.py", "not_found")
    long = "\n".join(f"line {i}" for i in range(80))
    cut = spark.createDataFrame([(long,)], "t string").select(T.truncated(F.col("t"), 10).alias("t")).first().t
    assert re.findall(r"line (\d+)", cut) == [str(i) for i in [*range(30), *range(60, 80)]]


def test_incremental(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "id int, v string, version int")
    assert {(r.id, r.v) for r in incremental.upsert(old, new, ["id"], "version").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {(r.id, r.change) for r in incremental.changes(new, old, "id", ["v"]).collect()} == {(1, "gone"), (2, "changed"), (3, "new")}
    assert incremental.get_or_create(old, new, "id").count() == 3


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in stream.windowed(events, "1 day").collect()}
    source = stream.table_stream(spark, str(tmp_path / "in"), events.schema, 10)
    query = stream.windowed(source, "1 day").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("windows").collect()} == batch
    stream.run_into(stream.table_stream(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "out"), str(tmp_path / "state"), lambda rows, to: rows.write.mode("append").parquet(to))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
