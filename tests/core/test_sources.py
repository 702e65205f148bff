import pytest

from stratalith.plans import reports
from stratalith.sources import definitions, files

FILES = {
    "src/SqlMapper.cs": """using System;
namespace Dapper
{
    // a class { in a comment
    public static class SqlMapper
    {
        public static IEnumerable<T> Query<T>(IDbConnection cnn, string sql)
        {
            cnn.Open();
            var x = "{ Fake( }";
            return cnn.Execute(sql);
        }
    }
}
""",
    "src/shop/order.py": """import os
from core.scanner import Scanner, walk
import numpy as np

class OrderProcessor(Base, mixins.Other):
    def calculate_total(self, items, rate=0.1):
        total = sum(items)
        return apply(total)

    async def send(self):
        await self.client.post(1)


def main():
    OrderProcessor().send()
""",
    "src/Shop.java": """import java.util.List;
public class Shop extends Base implements Runnable {
    private int n;
    public Shop(int n) { this.n = n; }
    public void run() {
        helper(n);
    }
    static List<String> names(String a, int b) throws Exception {
        return load(a);
    }
}
interface Cart { void add(int x); }
""",
    "web/app.ts": """import { a } from './lib';
const fs = require('fs');
export class View extends Base {
  async render(x) {
    return draw(x);
  }
}
export function start(a, b) {
  new View().render(a);
}
const later = async (x) => {
  start(x);
};
""",
    "web/lib.min.js": "function f(){}",
    "node_modules/x/index.js": "function g(){}",
    "notes.txt": "text",
    "latin.py": "# caf\xe9\nx = 1\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("project")
    for name, text in FILES.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode("latin-1" if name == "latin.py" else "utf-8"))
    (top / "big.py").write_bytes(b"#" * 300_000)
    return str(top)


def test_scan(spark, root):
    rows = {r.relative_path: r for r in files.scan(spark, root, most=200_000).collect()}
    assert {p: r.reason for p, r in rows.items()} == {
        "src/SqlMapper.cs": None, "src/shop/order.py": None, "src/Shop.java": None, "web/app.ts": None, "latin.py": None, "web/lib.min.js": "pattern", "node_modules/x/index.js": "dir", "notes.txt": "pattern", "big.py": "size",
    }
    assert rows["web/app.ts"].language == "typescript"
    assert sum(r.files for r in files.scan_statistics(files.scan(spark, root)).collect()) == 9


def test_sources_are_decoded(spark, root):
    texts = {r.relative_path: r.text for r in files.sources(spark, root, most=200_000).collect()}
    assert texts["src/Shop.java"] == FILES["src/Shop.java"] and "x = 1" in texts["latin.py"]
    lines = files.numbered_lines(files.sources(spark, root, most=200_000), 2).where("relative_path = 'src/Shop.java'").orderBy("line").collect()
    assert [(r.line, r.code) for r in lines] == list(enumerate(FILES["src/Shop.java"].split("\n")[:2], 1))


def test_entities(spark, root):
    found = definitions.entities(files.sources(spark, root, most=200_000))
    classes = {(r.relative_path, r.name): (r.start_line, r.end_line, r.bases, r.modifiers) for r in found["classes"].collect()}
    assert classes == {
        ("src/SqlMapper.cs", "SqlMapper"): (5, 13, [], ["public", "static"]),
        ("src/shop/order.py", "OrderProcessor"): (5, 11, ["Base", "mixins.Other"], []),
        ("src/Shop.java", "Shop"): (2, 11, ["Base", "Runnable"], ["public"]),
        ("src/Shop.java", "Cart"): (12, 12, [], []),
        ("web/app.ts", "View"): (3, 7, ["Base"], ["export"]),
    }
    functions = {(r.class_name, r.name): (r.start_line, r.end_line, r.return_type, r.calls) for r in found["functions"].collect()}
    assert functions == {
        ("SqlMapper", "Query"): (7, 12, "IEnumerable<T>", ["Execute", "Open"]),
        ("OrderProcessor", "calculate_total"): (6, 8, None, ["apply", "sum"]),
        ("OrderProcessor", "send"): (10, 11, None, ["post"]),
        (None, "main"): (14, 15, None, ["OrderProcessor", "send"]),
        ("Shop", "Shop"): (4, 4, "constructor", []),
        ("Shop", "run"): (5, 7, "void", ["helper"]),
        ("Shop", "names"): (8, 10, "List<String>", ["load"]),
        ("View", "render"): (4, 6, None, ["draw"]),
        (None, "start"): (8, 10, None, ["View", "render"]),
        (None, "later"): (11, 13, None, ["start"]),
    }
    imports = {(r.relative_path, r.module) for r in found["imports"].collect()}
    assert imports == {("src/SqlMapper.cs", "System"), ("src/shop/order.py", "os"), ("src/shop/order.py", "core.scanner"), ("src/shop/order.py", "numpy"), ("src/Shop.java", "java.util.List"), ("web/app.ts", "./lib"), ("web/app.ts", "fs")}
    counts = {r.relative_path: r.line_count for r in found["modules"].collect()}
    assert counts["src/SqlMapper.cs"] == 15
    lines = [r.line for r in reports.overview(found).collect()]
    assert lines[0] == "## Languages" and "- python: 2 files, 19 lines" in lines and lines.index("## Core modules") > 1
