import json
import os

import pytest

from stratalith.operators import storage
from stratalith.sources import files, tree

TREE = {
    "a.py": "x = 1\n", "big.py": "#" * 9000, "notes.txt": "t", "noending": "n", ".hidden.py": "h = 1", "src/Main.java": "class Main {}", "src/deep/er/x.ts": "let x;", "src/lib.min.js": "f()",
    "node_modules/p/index.js": "g()", "src/node_modules/q/r.js": "h()", "go/pkg/mod.py": "m", "x/custom/path/y.py": "no", "custom/path/z.py": "no", "x/custom/path/sub/w.py": "no", "src/test/t.py": "no",
}
DIRS = ["node_modules", "test", "custom/path", "go/p*"]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (top / "latin.py").write_bytes("# caf\xe9\n".encode("latin-1"))
    (top / "empty/inner").mkdir(parents=True)
    os.symlink(top / "src", top / "linked")
    return str(top)


def found(df):
    return {r.relative_path: (r.kind, r.reason) for r in df.collect()}


@pytest.mark.parametrize("tasks", [1, 3, 50])
def test_excluded_folders_are_one_row(spark, root, tasks):
    got = found(tree.walked(spark, root, DIRS, ["*.min.js", "*.txt"], 5000, tasks=tasks))
    assert got == {
        "a.py": ("file", None), "latin.py": ("file", None), ".hidden.py": ("file", None), "src/Main.java": ("file", None), "src/deep/er/x.ts": ("file", None),
        "big.py": ("file", "size"), "notes.txt": ("file", "pattern"), "src/lib.min.js": ("file", "pattern"), "noending": ("file", "language"),
        "node_modules": ("folder", "dir"), "src/node_modules": ("folder", "dir"), "src/test": ("folder", "dir"), "go/pkg": ("folder", "dir"), "custom/path": ("folder", "dir"),
        "x/custom/path/y.py": ("file", "dir"), "x/custom/path/sub": ("folder", "dir"),
    }


def test_counters(spark, root):
    row = tree.counters(tree.walked(spark, root, DIRS, ["*.min.js", "*.txt"], 5000)).first()
    assert tuple(row) == (5, 6, 5)


def test_excluded_folders_are_never_listed(spark, root, tmp_path):
    """A folder that can't be listed doesn't matter if it is excluded: the log of listings doesn't hold it."""
    reader = tree.TreeReader({"path": root, "dirs": json.dumps(DIRS), "content": "true", "tasks": "2"})
    listed, read = [], []
    entries, content = tree.LocalStore.entries, tree.LocalStore.content
    try:
        tree.LocalStore.entries = lambda self, r: (listed.append(r), entries(self, r))[1]
        tree.LocalStore.content = lambda self, r: (read.append(r), content(self, r))[1]
        list(reader.pushFilters([tree.EqualTo(("suffix",), ".py"), tree.LessThan(("size",), 5000)]))
        rows = [r for p in reader.partitions() for r in reader.read(p)]
    finally:
        tree.LocalStore.entries, tree.LocalStore.content = entries, content
    assert not any("node_modules" in p or p.endswith(("test", "pkg", "custom/path/sub")) for p in listed)
    assert sorted(read) == [".hidden.py", "a.py", "latin.py"] and {r[2] for r in rows} >= set(read)


def test_filters_are_pushed(spark, root):
    rows = tree.walked(spark, root, DIRS, content=True)
    asked = rows.where("suffix IN ('.py', '.java') AND size < 5000 AND relative_path LIKE 'src/%'")
    assert found(asked) == {"src/Main.java": ("file", None)}
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert " IN (" not in plan and "StartsWith" not in plan.split("PushedFilters")[0] and "BatchScan" in plan
    assert found(rows.where("size >= 13 AND size <= 13")) == {"src/Main.java": ("file", None)}
    assert found(rows.where("relative_path LIKE 'src/%' AND relative_path LIKE 'x/%'")) == {}
    assert found(rows.where("kind = 'folder' AND size IS NULL")).keys() == {"node_modules", "src/node_modules", "src/test", "go/pkg", "custom/path", "x/custom/path/sub"}


def test_texts_and_agreement_with_the_listing(spark, root):
    texts = {r.relative_path: r.text for r in tree.texts(tree.walked(spark, root, content=True)).collect()}
    listed = {r.relative_path for r in files.scan(spark, root).where("reason IS NULL").collect() if not r.relative_path.startswith("linked")}
    assert texts["latin.py"] == "# caf\xe9\n" and set(texts) == listed | {".hidden.py"}  # the file listing leaves hidden files out
    paths = spark.createDataFrame([("latin.py",), ("src/Main.java",), ("gone.py",)], "relative_path string")
    assert {r.relative_path: r.text for r in tree.read_texts(paths, root).collect()} == {p: texts[p] for p in ("latin.py", "src/Main.java")}


def test_missing_and_empty_roots(spark, tmp_path):
    assert tree.walked(spark, str(tmp_path)).count() == 0
    assert tuple(tree.counters(tree.walked(spark, str(tmp_path))).first()) == (0, 0, 0)
    with pytest.raises(Exception, match="nowhere"):
        tree.walked(spark, str(tmp_path / "nowhere")).count()


def test_written_trees(spark, tmp_path):
    rows = spark.createDataFrame([("p/q/a.py", "x"), ("b.java", None), ("p/c.ts", "é")], "relative_path string, text string")
    written = storage.stored(tree.write_tree(rows, f"file://{tmp_path}/out"), "written")
    assert {tuple(r) for r in written.collect()} == {("p/q/a.py", 1), ("b.java", 0), ("p/c.ts", 2)}
    assert {r.relative_path: r.text for r in tree.texts(tree.walked(spark, f"file://{tmp_path}/out", content=True)).collect()} == {"p/q/a.py": "x", "b.java": "", "p/c.ts": "é"}
