import random

import pytest
from pyspark.sql import functions as F

from stratalith.operators import buckets
from stratalith.plans import knowledge_base

SCHEMA = "k string, v bigint, version bigint"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def folders(table):
    return {b: v for b, (v, _) in table.state().items()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = buckets.BucketedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 8)
    assert rows(table.read()) == [] and table.read([3]).schema == table.schema
    first = spark.createDataFrame([(f"k{i}", i, 1) for i in range(40)] + [(None, 7, 1), ("k1", 1, 1)], SCHEMA)
    table.replace(first)
    assert rows(table.read()) == rows(first)  # repeated rows and a null key stay
    before = folders(table)
    again = spark.createDataFrame([("k3", 300, 2, "x")], SCHEMA + ", __marker string")
    table.exchange(again, again, "k", table.touched(again))
    after = folders(table)
    assert [b for b in after if after[b] != before[b]] == table.touched(again) and len(table.touched(again)) == 1
    assert rows(table.read()) == rows(first.where("k IS NULL OR k <> 'k3'").unionByName(again.drop("__marker")))
    table.replace(first.limit(0), table.touched(again))  # an emptied bucket stays empty
    assert rows(table.read(table.touched(again))) == [] and rows(table.read()) == rows(first.where(table.bucket() != table.touched(again)[0]))
    assert rows(buckets.BucketedTable(spark, table.path, SCHEMA, "k", 4).read()) == []


def test_upserts_and_old_versions(spark, tmp_path):
    table = buckets.BucketedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 4)
    dice, wanted = random.Random(5), {}
    for step in range(6):
        new = {f"k{dice.randrange(12)}": dice.randrange(100) for _ in range(3)}
        wanted |= {k: (k, v, step) for k, v in new.items()}
        table.upsert(spark.createDataFrame([(k, v, step) for k, v in new.items()], SCHEMA), ["k"], "version")
        assert rows(table.read()) == sorted(wanted.values(), key=repr)
    used = set(folders(table).values())
    assert used <= set(table.versions()) and len(table.versions()) <= len(used) + 4


def test_a_failed_write_changes_nothing(spark, tmp_path):
    table = buckets.BucketedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 4)
    good = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], SCHEMA)
    table.replace(good)
    with pytest.raises(Exception, match="stop here"):
        table.replace(good.withColumn("v", F.when(F.col("k") == "b", F.raise_error(F.lit("stop here")).cast("bigint")).otherwise(F.col("v"))))
    assert rows(table.read()) == rows(good)
    table.replace(good.where("k = 'a'"))
    assert rows(table.read()) == [("a", 1, 1)]


def test_a_hot_key_is_written_by_several_tasks(spark, tmp_path):
    table = buckets.BucketedTable(spark, str(tmp_path / "t"), "k string, v string", "k", 4)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        table.replace(spark.range(40000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    hot = table.touched(spark.createDataFrame([("hot",)], "k string"))[0]
    assert table.read().count() == 40000 and table.read([hot]).where("k = 'hot'").count() == 13334
    assert len(list((tmp_path / "t" / "v-00000001" / f"bucket=4-{hot}").glob("*.parquet"))) > 3


NAMES = ("modules", "classes", "functions", "imports", "variables", "edges", "dependencies", "code_index", "definitions", "calls", "pending")


def source(dice, i):
    calls = "".join(f"    f{dice.randrange(9)}()\n" for _ in range(2))
    return f"import m{dice.randrange(8)}\n\n\ndef f{dice.randrange(9)}():\n{calls}\n\nclass C{i}:\n    def f{dice.randrange(9)}(self):\n        return f{dice.randrange(9)}()\n"


def state(base):
    return {n: rows(base.read(n)) for n in NAMES} | {"files": rows(base.read("files").select("relative_path", "text"))}


def test_updates_equal_a_new_build(spark, tmp_path, monkeypatch):
    """Random changes, one of the builds killed after any of its writes, against a build from nothing; a quiet change rewrites one bucket
    of each table by path."""
    top, dice = tmp_path / "source", random.Random(11)
    top.mkdir()
    for i in range(7):
        (top / f"m{i}.py").write_text(source(dice, i))
    base = knowledge_base.KnowledgeBase(spark, str(tmp_path / "kb"), "p", 16)
    assert base.build(str(top)) == {"changed": 7, "gone": 0}
    (top / "m3.py").write_text((top / "m3.py").read_text() + "\n\nx = 1\n")
    before = {n: folders(base.table(n)) for n in ("files", "modules", "functions", "imports", "code_index", "dependencies", "edges")}
    assert base.build(str(top)) == {"changed": 1, "gone": 0}
    wrote = {n: sum(v != before[n].get(b) for b, v in folders(base.table(n)).items()) for n in before}
    assert {n: wrote[n] for n in wrote if n != "edges"} == dict.fromkeys([n for n in wrote if n != "edges"], 1) and wrote["edges"] <= 6
    replace = buckets.BucketedTable.replace
    for kill in (3, 9):
        (top / f"m{dice.randrange(7)}.py").write_text(source(dice, 20 + kill) + "# changed\n")
        victim = top / f"m{dice.randrange(7)}.py"
        victim.unlink(missing_ok=True)
        (top / f"m{kill}.py").write_text(source(dice, kill) + "# longer\n")
        done = []

        def dying(self, *a, **k):
            done.append(self.path)
            if len(done) > kill:  # noqa: B023
                raise ZeroDivisionError
            return replace(self, *a, **k)

        monkeypatch.setattr(buckets.BucketedTable, "replace", dying)
        with pytest.raises(ZeroDivisionError):
            base.build(str(top))
        monkeypatch.setattr(buckets.BucketedTable, "replace", replace)
        (top / f"m{kill}.py").write_text(source(dice, 40 + kill))  # what the killed build wrote is old now
        base.build(str(top))
        new = knowledge_base.KnowledgeBase(spark, str(tmp_path / f"kb{kill}"), "p", 16)
        new.build(str(top))
        assert state(base) == state(new)
    assert base.build(str(top)) == {"changed": 0, "gone": 0}
