"""A completer that counts sees each prompt once."""

import os

import pytest

from stratalith.plans import analysis, answers


def counting(log, fails=()):
    """Writes each prompt to a log; fails for batches that hold one of ``fails`` until its mark is there."""

    def run(prompts):
        with open(log, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        for p in prompts:
            mark = f"{log}-{p}"
            if p in fails and not os.path.exists(mark):
                open(mark, "w").close()
                raise OSError(p)
        return [p.upper() for p in prompts]

    return run


def lines(log):
    return sorted(open(log).read().split("\n")[:-1]) if os.path.exists(log) else []


def test_each_prompt_once_over_actions_and_runs(spark, tmp_path):
    log = str(tmp_path / "log")
    ledger = answers.Answers(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([(i, f"p{i % 40}") for i in range(100)] + [(100, None), (101, "")], "id long, text string").withColumnRenamed("text", "prompt")
    for _ in range(3):
        told = analysis.completed(rows, "prompt", counting(log), ledger)
        for _ in range(2):
            assert {r["id"]: r["answer"] for r in told.collect()} == {**{i: f"P{i % 40}" for i in range(100)}, 100: "", 101: ""}
    assert lines(log) == sorted({f"p{i}" for i in range(40)} | {""})
    more = rows.union(spark.createDataFrame([(200, "new")], "id long, prompt string"))
    assert ledger.ensure(more, counting(log)) == {"asked": 1, "failed": 0}


def test_failed_batches_are_asked_again(spark, tmp_path):
    log = str(tmp_path / "log")
    ledger = answers.Answers(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([(f"p{i}",) for i in range(200)], "prompt string")
    first = ledger.ensure(rows, counting(log, {"p7"}), size=2)
    assert first["asked"] == 200 and 1 <= first["failed"] <= 2
    assert ledger.read().count() == 200 - first["failed"]
    assert ledger.ensure(rows, counting(log, {"p7"}), size=2) == {"asked": first["failed"], "failed": 0}
    assert {r["answer"] for r in ledger.read().collect()} == {f"P{i}" for i in range(200)}


def test_a_lost_task_goes_on(tmp_path):
    """The task is repeated from its start, but asks only for what no file holds."""
    import pyarrow as pa

    log, root = str(tmp_path / "log"), str(tmp_path / "ledger")
    rows = pa.RecordBatch.from_arrays([pa.array([3] * 10), pa.array([f"d{i}" for i in range(10)]), pa.array([f"p{i}" for i in range(10)])], ["bucket", "digest", "prompt"])
    lost = answers.asked(root, counting(log), 4)([rows])
    next(lost)  # one batch was written when the executor went
    list(answers.asked(root, counting(log), 4)([rows]))
    assert lines(log) == sorted(f"p{i}" for i in range(10)) and answers.written(root, 3) == {f"d{i}" for i in range(10)}
    assert all(not n.startswith("_") for n in os.listdir(f"{root}/bucket=3"))


def test_results_and_cache_hold_the_same_answers(spark, tmp_path):
    log = str(tmp_path / "log")
    cache = spark.createDataFrame([], "target_type string, target_name string, path string, code_hash string, result string, manually_corrected boolean, updated timestamp")
    targets = spark.createDataFrame([("function", f"f{i}", "a.py", f"x = {i}", f"p{i}") for i in range(5)], "target_type string, target_name string, path string, code string, prompt string")
    results, after = analysis.analysed(targets, cache, counting(log))
    for _ in range(3):
        results.collect(), after.collect()
    assert lines(log) == [f"p{i}" for i in range(5)]


def test_empty(spark, tmp_path):
    ledger = answers.Answers(spark, str(tmp_path / "none"))
    assert ledger.read().count() == 0
    assert ledger.ensure(spark.createDataFrame([], "prompt string"), pytest.fail) == {"asked": 0, "failed": 0}
