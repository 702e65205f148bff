"""A project's knowledge base: Parquet tables in one folder per project, in hash buckets of the path or the name.

A build writes the buckets that changed files touch, each table's in one job to a new version folder; a bucket's state is its latest
version whose job was committed. One build runs at a time; with another number of buckets the tables are built anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import buckets, graph, incremental, ranking, relational, storage
from ..schema import BUCKETED, TABLES
from ..sources import definitions, files, tree


class KnowledgeBase:
    """The tables of one project under ``root``/``project``."""

    def __init__(self, spark: SparkSession, root: str, project: str, buckets: int = 64) -> None:
        self.spark, self.root, self.project, self.buckets = spark, root.rstrip("/"), project, buckets

    def path(self, name: str) -> str:
        return f"{self.root}/{self.project}/{name}"

    def table(self, name: str) -> buckets.BucketedTable:
        """A table in buckets (see ``BUCKETED``)."""
        key = T.simple_name(F.col("dst")) if name == "edges" else BUCKETED[name]
        return buckets.BucketedTable(self.spark, self.path(name), TABLES[name], key, self.buckets)

    def versions(self, name: str) -> list[str]:
        """The complete versions of a table, the latest last: those whose job was committed."""
        return self._whole(name).versions()

    def read(self, name: str) -> DataFrame:
        """The present state of a table, empty if it was never written; missing columns are null (migration)."""
        return self.table(name).read() if name in BUCKETED else self._whole(name).read()

    def _whole(self, name: str) -> buckets.BucketedTable:
        """A table that is always written whole: one bucket."""
        return buckets.BucketedTable(self.spark, self.path(name), TABLES[name], F.lit(0), 1)

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a table anew; the version before stays for readers that have begun, older ones go."""
        (self.table(name) if name in BUCKETED else self._whole(name)).replace(rows)
        return self.read(name)

    def file(self, path: str) -> DataFrame:
        """The cached file of a path: as it is, with other separators, or by its name."""
        return files.resolved(self.read("files"), path)

    def module(self, path: str, root: str = "") -> DataFrame:
        return files.module_at(self.read("modules"), path, root)

    def upsert(self, name: str, new: DataFrame, keys: list[str], version: str = "updated") -> DataFrame:
        """Add rows, of each key the latest stays; a table in buckets whose key is among ``keys`` is written where the new rows lie."""
        if BUCKETED.get(name) in keys and name != "edges":
            self.table(name).upsert(new, keys, version)
            return self.read(name)
        return self.write(name, storage.stored(incremental.upsert(self.read(name), new, keys, version), "upserted"))

    def build(self, source_root: str, **options) -> dict[str, int]:
        """Bring the tables up to date with a source tree; only files whose size or time changed are parsed again.

        Rows of changed and vanished files go from all tables (a cascade), rows of changed and new ones are added; of each table
        only the buckets that hold them are written. ``pending`` names the files of a build that hasn't ended and the names that they
        define or call, before and after: the next build takes these files as changed, whatever was written of them.
        """
        kept = tree.walked(self.spark, source_root, **options).where("reason IS NULL")
        scanned = storage.stored(kept.select("relative_path", files.language_of(F.col("relative_path")).alias("language"), "size", "modified"), "scanned")
        cached, pending = self.read("files").select("relative_path", "size", "modified"), self.read("pending")
        unfinished = pending.select("relative_path").distinct()
        changed = incremental.unchanged_skipped(scanned, cached.join(unfinished, "relative_path", "left_anti"), "relative_path", ["size", "modified"])
        known = cached.select("relative_path").unionByName(unfinished).distinct()
        gone = storage.stored(known.join(scanned, "relative_path", "left_anti"), "gone")
        fresh = storage.stored(tree.read_texts(changed, source_root), "fresh")
        touched = storage.stored(fresh.select("relative_path").unionByName(gone).distinct(), "touched")
        if touched.isEmpty():
            return {"changed": 0, "gone": 0}
        found = definitions.entities(fresh)
        content = fresh.select("relative_path", "text")
        functions = found["functions"].join(content, "relative_path").withColumn("content", files.sliced(F.col("text"), F.col("start_line"), F.col("end_line"))).drop("text")
        found["functions"] = storage.stored(functions, "functions")
        places = self.table("files").touched(touched, F.col("relative_path"))
        old = self.table("functions").read(places).join(touched, "relative_path", "left_semi")
        self.write("pending", storage.stored(pending.unionByName(names_of(old)).unionByName(names_of(found["functions"])).unionByName(touched, allowMissingColumns=True).distinct(), "pending"))
        for name, rows in found.items():
            self.table(name).exchange(rows, touched, "relative_path", places)
        self.link()
        self.table("files").exchange(fresh, touched, "relative_path", places)
        self.write("pending", self.spark.createDataFrame([], TABLES["pending"]))  # last: a build that failed before is repeated by the next one
        return {"changed": fresh.count(), "gone": gone.count()}

    def link(self) -> None:
        """The tables that depend on several files, for the files and names that are pending: edges, dependencies, index."""
        pending = self.read("pending")
        touched = pending.select("relative_path").distinct()
        places = self.table("files").touched(touched, F.col("relative_path"))
        functions, modules, imports, classes = (self.table(n).read(places).join(touched, "relative_path", "left_semi") for n in ("functions", "modules", "imports", "classes"))
        self._link_calls(functions, touched, pending.where("name IS NOT NULL"))
        self._link_modules(modules, imports, touched)
        index = ranking.build_index(snippets(modules, classes, functions))
        self.table("code_index").exchange(index, touched.select(F.col("relative_path").alias("path")), "path", places)

    def _link_calls(self, functions: DataFrame, touched: DataFrame, names: DataFrame) -> None:
        """A name's calls are resolved by its calls and definitions alone: all of a touched name's bucket is resolved again."""
        named = functions.select("relative_path", function_id().alias("id"), "calls", F.struct("relative_path", "start_line", "name").alias("pos"))
        places = self.table("definitions").touched(names)
        defined = named.groupBy("relative_path", "id").agg(F.min("pos").alias("pos")).withColumn("name", T.simple_name(F.col("id")))
        called = named.select("relative_path", F.col("id").alias("caller"), F.explode("calls").alias("callee")).withColumn("name", F.substring_index("callee", ".", -1))
        for name, rows in (("definitions", defined), ("calls", called)):
            self.table(name).exchange(rows, touched, "relative_path", places)
        self.table("edges").replace(graph.resolve_calls(self.table("calls").read(places), self.table("definitions").read(places)), places)

    def _link_modules(self, modules: DataFrame, imports: DataFrame, touched: DataFrame) -> None:
        """Touched files' imports meet all modules; the others' imports meet the modules that the last build didn't have, and their dependencies
        on modules that are no more go."""
        before, after = (self.read(n).select(F.col("relative_path").alias("path")) for n in ("files", "modules"))
        path = touched.select(F.col("relative_path").alias("path"))
        own = graph.module_dependencies(imports.select(F.col("relative_path").alias("path"), "module"), after)
        fresh = modules.select(F.col("relative_path").alias("path")).join(before, "path", "left_anti")
        others = self.read("imports").select(F.col("relative_path").alias("path"), "module").join(path, "path", "left_anti")
        lost = path.join(after, "path", "left_anti").select(F.col("path").alias("depends_on"))
        added = storage.stored(own.unionByName(graph.module_dependencies(others, fresh)), "dependencies")
        table = self.table("dependencies")
        stale = table.read().join(lost, "depends_on", "left_semi")
        places = buckets.together([table.touched(path), table.touched(added), table.touched(stale)])
        old = table.read(places).join(path, "path", "left_anti").join(lost, "depends_on", "left_anti")
        table.replace(old.unionByName(added, allowMissingColumns=True).distinct(), places)

    def overview(self) -> DataFrame:
        """One row: modules, classes, functions, lines."""
        one = self.read("modules").agg(F.count("*").alias("modules"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"))
        for name in ("classes", "functions"):
            one = one.crossJoin(self.read(name).agg(F.count("*").alias(name)))  # one row each
        return one

    def class_detail(self, name: str) -> DataFrame:
        """Classes of a name with their methods in order."""
        methods = self.read("functions").groupBy("relative_path", F.col("class_name").alias("name")).agg(F.array_sort(F.collect_list(F.struct("start_line", F.struct("name", "end_line", "return_type", "content").alias("method")))).alias("methods"))
        return self.read("classes").where(F.col("name") == name).join(methods, ["relative_path", "name"], "left")

    def find(self, word: str, number: int = 20) -> DataFrame:
        """Classes and functions whose name contains the word, shortest first."""
        parts = {"class": self.read("classes"), "function": self.read("functions")}
        rows = relational.tagged_union({k: df.select("name", "relative_path", "start_line", "end_line") for k, df in parts.items()})
        return relational.shortest_matches(rows, "name", word, ["relative_path", "start_line", "kind"], number)

    def search(self, question: str, number: int = 8, budget: int = 3000) -> DataFrame:
        return ranking.search(self.read("code_index"), ranking.Question.of(question), number, budget)


def names_of(functions: DataFrame) -> DataFrame:
    """(relative_path, name): the simple names that functions have and call."""
    own = functions.select("relative_path", T.simple_name(function_id()).alias("name"))
    return own.unionByName(functions.select("relative_path", F.explode("calls").alias("name")).withColumn("name", F.substring_index("name", ".", -1))).distinct()


def function_id():
    """``path:function`` or ``path:Class.method``."""
    return F.concat(F.col("relative_path"), F.lit(":"), F.when(F.col("class_name").isNotNull(), F.concat("class_name", F.lit("."))).otherwise(""), F.col("name"))


def snippets(modules: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """What the index holds: modules, classes with their methods' names, functions."""
    parameters = F.transform("parameters", lambda p: F.struct(F.element_at(F.split(p, r"\s+"), -1).alias("name"), F.when(F.contains(F.trim(p), F.lit(" ")), F.element_at(F.split(F.trim(p), r"\s+"), 1)).alias("type")))
    methods = functions.where("class_name IS NOT NULL").groupBy("relative_path", F.col("class_name").alias("name")).agg(F.array_sort(F.collect_set("name")).alias("methods"))
    of_class = classes.join(methods, ["relative_path", "name"], "left")
    rows = relational.tagged_union({
        "module": modules.select(F.col("relative_path").alias("name"), F.col("relative_path").alias("path"), F.lit(0).alias("start_line"), F.col("line_count").alias("end_line"), F.concat(F.lit("module "), "relative_path").alias("signature")),
        "class": of_class.select("name", F.col("relative_path").alias("path"), "start_line", "end_line", T.class_signature(F.col("name"), F.col("bases"), F.coalesce("methods", F.array().cast("array<string>"))).alias("signature")),
        "function": functions.select(F.concat_ws(".", "class_name", "name").alias("name"), F.col("relative_path").alias("path"), "start_line", "end_line", T.function_signature(F.col("name"), parameters, F.col("return_type"), F.col("modifiers")).alias("signature")),
    })
    return rows.withColumn("pos", F.col("start_line").cast("bigint"))


def projects(spark: SparkSession, root: str, hint: str = "") -> list[str]:
    """The projects under a root whose name contains the hint (in any case), the latest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getModificationTime(), s.getPath().getName()) for s in system.listStatus(path) if s.isDirectory()]
    return [name for _, name in sorted(found, reverse=True) if hint.lower() in name.lower()]
