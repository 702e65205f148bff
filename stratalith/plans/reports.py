"""Markdown reports as tables of numbered lines, written as text by Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import relational


def table_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``line``: each row as a row of a Markdown table."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |")).alias("line"))


def section(number: int, title: str, rows: DataFrame, order: list[Column], line: Column, most: int | None = None) -> DataFrame:
    """(section, place, line): a heading, then the rows' lines in order, the first ``most`` only if given."""
    spark = rows.sparkSession
    chosen = rows.orderBy(*order).limit(most) if most else rows
    body = chosen.select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("place"), line.alias("line"))
    head = spark.createDataFrame([(number, 0, f"## {title}", None)], "section int, part int, line string, place string")
    text = body.select(F.lit(number).alias("section"), F.lit(1).alias("part"), "line", F.to_json("place").alias("place"))
    return head.unionByName(text)


def report(sections: list[DataFrame]) -> DataFrame:
    """All sections' lines in order."""
    return reduce(DataFrame.unionByName, sections).orderBy("section", "part", F.col("place").asc_nulls_first(), "line").select("line")


def overview(entities: dict[str, DataFrame]) -> DataFrame:
    """The light report: totals, languages, largest modules."""
    modules, classes, functions = (entities[k] for k in ("modules", "classes", "functions"))
    members = classes.select("relative_path").withColumn("w", F.lit(10)).unionByName(functions.select("relative_path").withColumn("w", F.lit(1)))
    scored = modules.join(members.groupBy("relative_path").agg(F.sum("w").alias("score")), "relative_path", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    languages = modules.groupBy("language").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))
    return report([
        section(1, "Languages", languages, [F.col("language")], F.concat_ws("", F.lit("- "), "language", F.lit(": "), F.format_number("files", 0), F.lit(" files, "), F.format_number("lines", 0), F.lit(" lines"))),
        section(2, "Core modules", scored.orderBy(F.desc("score"), "relative_path").limit(20), [F.lpad((F.lit(10**9) - F.col("score")).cast("string"), 10, "0"), F.col("relative_path")], F.concat_ws("", F.lit("- "), "relative_path", F.lit(" ("), "score", F.lit(")"))),
    ])


# Listings of any size: rows (path, part, place, line), where (path, part, place) is the lines' order.


def listed(rows: DataFrame, part: int, place: Column, line: Column) -> DataFrame:
    return rows.select("path", F.lit(part).alias("part"), place.cast("bigint").alias("place"), line.alias("line"))


def signature(name: Column, parameters: Column, return_type: Column) -> Column:
    """``name(a, b) -> type`` of an array of parameter names."""
    returns = F.when(return_type != "", F.concat(F.lit(" -> `"), return_type, F.lit("`"))).otherwise("")
    return F.concat(F.lit("`"), name, F.lit("("), F.array_join(parameters, ", "), F.lit(")`"), F.coalesce(returns, F.lit("")))


def full(modules: DataFrame, imports: DataFrame, classes: DataFrame, functions: DataFrame, most_calls: int = 10) -> DataFrame:
    """The full report's lines of every module: its heading and summary, imports, classes with their methods, functions with
    signature, summary and first calls. modules: path, language, line_count, summary; imports: path, line, module; classes:
    path, name, start_line, end_line, bases; functions: path, class_name, name, start_line, end_line, parameters,
    return_type, summary, calls."""
    lines = lambda a, b: F.concat(F.lit(" (lines "), a, F.lit("-"), b, F.lit(")"))
    bases = F.when(F.size("bases") > 0, F.concat(F.lit(" extends "), F.array_join("bases", ", "))).otherwise("")
    calls = F.concat(F.lit("calls: "), F.array_join(F.slice("calls", 1, most_calls), ", "), F.when(F.size("calls") > most_calls, "...").otherwise(""))
    sign = signature(F.col("name"), F.col("parameters"), F.col("return_type"))
    methods, free = functions.where("class_name IS NOT NULL"), functions.where("class_name IS NULL")
    parts = [
        listed(modules, 0, F.lit(0), F.concat(F.lit("### "), "path")),
        listed(modules, 1, F.lit(0), F.concat(F.lit("> language: "), "language", F.lit(", lines: "), "line_count")),
        listed(modules.where("summary <> ''"), 2, F.lit(0), F.col("summary")),
        listed(imports, 3, F.col("line"), F.concat(F.lit("- import `"), "module", F.lit("`"))),
        listed(classes, 4, F.col("start_line"), F.concat(F.lit("#### "), "name", lines("start_line", "end_line"), bases)),
        listed(methods, 4, F.col("start_line"), F.concat(F.lit("- "), "class_name", F.lit(": "), sign)),
        listed(free, 5, F.col("start_line"), F.concat(F.lit("#### "), "name", lines("start_line", "end_line"))),
        listed(free, 6, F.col("start_line"), sign),
        listed(free.where("summary <> ''"), 7, F.col("start_line"), F.col("summary")),
        listed(free.where(F.size("calls") > 0), 8, F.col("start_line"), calls),
    ]
    return reduce(DataFrame.unionByName, parts)


def summary(name: str, modules: DataFrame, architecture: str = "", business: str = "", most: int = 10) -> DataFrame:
    """place, line: totals, the two texts, and the first modules with their summaries."""
    spark = modules.sparkSession
    totals = modules.agg(F.count("*").alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"))
    entries = F.array(F.lit(f"# {name}"), F.concat(F.lit("- files: "), "files"), F.concat(F.lit("- lines: "), "lines"))
    head = totals.select(F.posexplode(entries).alias("place", "line"))
    texts = spark.createDataFrame([(10, "## Architecture"), (11, architecture or "not analysed"), (12, "## Business logic"), (13, business or "not analysed"), (14, "## Modules")], "place int, line string")
    first = modules.orderBy("path").limit(most)
    rank = F.row_number().over(Window.orderBy("path"))  # of at most ``most`` rows
    said = first.select((rank * 2 + 18).alias("place"), F.array(F.concat(F.lit("### "), "path"), T.or_default(F.col("summary"), "no summary")).alias("both"))
    body = said.select("place", F.posexplode("both").alias("i", "line")).select((F.col("place") + F.col("i")).alias("place"), "line")
    return head.unionByName(texts).unionByName(body).select(F.col("place").cast("bigint").alias("place"), "line")


def by_directory(modules: DataFrame, classes: DataFrame, most: int = 20) -> DataFrame:
    """(path, part, place, line), path being the parent directory: the split report's listing of modules (path, line_count,
    n_functions) with their first classes (path, start_line, name)."""
    parent, name = T.parent_dir(F.col("path")), T.base_name(F.col("path"))
    sized = modules.join(classes.groupBy("path").agg(F.count("*").alias("n_classes")), "path", "left").na.fill(0, ["n_classes"])
    rank = F.row_number().over(Window.partitionBy(parent).orderBy("path")).cast("bigint")
    rows = sized.select("path", parent.alias("parent"), rank.alias("rank"), F.concat(F.lit("### "), name, F.lit(": "), "line_count", F.lit(" lines, "), "n_classes", F.lit(" classes, "), "n_functions", F.lit(" functions")).alias("line"), "n_classes")
    heads = rows.select(F.col("parent").alias("path")).distinct().select("path", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("place"), F.concat(F.lit("## "), "path").alias("line"))
    own = rows.select(F.col("parent").alias("path"), F.lit(1).alias("part"), F.col("rank").alias("place"), "line")
    first = relational.first_of_each(classes.select("path", "start_line", "name"), ["path"], [F.col("start_line"), F.col("name")], most).join(rows.select("path", "parent", "rank"), "path")
    named = first.select(F.col("parent").alias("path"), F.lit(1).alias("part"), F.col("rank").alias("place"), F.concat(F.lit("- `"), "name", F.lit("`")).alias("line"))
    more = rows.where(F.col("n_classes") > most).select(F.col("parent").alias("path"), F.lit(1).alias("part"), F.col("rank").alias("place"), F.concat(F.lit("- and "), F.col("n_classes") - most, F.lit(" more")).alias("line"))
    return reduce(DataFrame.unionByName, [heads, own, named, more])


def core_modules(modules: DataFrame, most: int = 50) -> DataFrame:
    """place, line of the modules (path, n_classes, n_functions) with most members."""
    order = [F.desc(F.col("n_classes") + F.col("n_functions")), F.col("path")]
    first = modules.orderBy(*order).limit(most)
    rank = F.row_number().over(Window.orderBy(*order)).cast("bigint")  # of at most ``most`` rows
    return first.select(rank.alias("place"), F.concat(F.lit("## "), "path", F.lit(": "), "n_classes", F.lit(" classes, "), "n_functions", F.lit(" functions")).alias("line"))


def tree(paths: DataFrame, deepest: int = 3) -> DataFrame:
    """prefix, line: every directory above the files (path) with the number of files below it, indented by its depth."""
    parts = paths.select(F.split(T.normal_path(F.col("path")), "/").alias("parts")).where(F.size("parts") > 1)
    last = F.least(F.size("parts") - 1, F.lit(deepest + 1))
    above = parts.select(F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.array_join(F.slice("parts", 1, i), "/").alias("prefix"), i.alias("depth"), F.get(F.col("parts"), i - 1).alias("name")))).alias("x"))
    counted = above.groupBy("x.prefix", "x.depth", "x.name").agg(F.count("*").alias("n"))
    return counted.select("prefix", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("- **"), "name", F.lit("/** ("), "n", F.lit(" files)")).alias("line"))


def index_summary(classes: DataFrame, functions: DataFrame, most_classes: int = 20, most_functions: int = 30) -> DataFrame:
    """(kind, place, name, n, path): the classes (path, name, n_methods) with most methods, and the methods (path, class_name,
    name, start_line, end_line) of most lines; functions outside of classes don't count."""
    methods = functions.where("class_name IS NOT NULL").select(F.concat("class_name", F.lit("."), "name").alias("name"), (F.col("end_line") - F.col("start_line")).cast("bigint").alias("n"), "path")
    parts = []
    for kind, rows, most in (("class", classes.select("name", F.col("n_methods").cast("bigint").alias("n"), "path"), most_classes), ("function", methods, most_functions)):
        order = [F.desc("n"), F.col("name"), F.col("path")]
        place = F.row_number().over(Window.orderBy(*order)).cast("bigint")  # of at most ``most`` rows
        parts.append(rows.orderBy(*order).limit(most).select(F.lit(kind).alias("kind"), place.alias("place"), "name", "n", "path"))
    return parts[0].unionByName(parts[1])


def project_overview(totals: DataFrame, directories: DataFrame, index: DataFrame) -> DataFrame:
    """value: one JSON text of totals (one row), files by top directory (name, files) and the index summary."""
    pick = lambda kind, name: F.transform(F.filter("all", lambda x: x["kind"] == kind), lambda x: F.struct(x["name"].alias("name"), x["n"].alias(name), x["path"].alias("file")))
    listed_index = index.agg(F.array_sort(F.collect_list(F.struct("kind", "place", "name", "n", "path"))).alias("all")).select(pick("class", "methods").alias("top_classes"), pick("function", "lines").alias("top_functions"))
    structure = directories.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "files")))).alias("structure"))  # a row for each top directory
    one = totals.select(F.struct(*totals.columns).alias("stats")).crossJoin(structure).crossJoin(listed_index)  # one row each
    return one.select(F.to_json(F.struct("stats", "structure", "top_classes", "top_functions")).alias("value"))


def overview_text(directories: DataFrame, index: DataFrame) -> DataFrame:
    """(section, place, line): the overview as text, with the first 10 directories, 15 classes and 10 functions."""
    rank = F.row_number().over(Window.orderBy("name")).cast("bigint")  # of at most ten rows
    dirs = directories.orderBy("name").limit(10).select(F.lit("directories").alias("section"), rank.alias("place"), F.concat(F.lit("  "), "name", F.lit("/ ("), "files", F.lit(" files)")).alias("line"))
    said = lambda kind, most, unit: index.where((F.col("kind") == kind) & (F.col("place") <= most)).select(F.lit(kind).alias("section"), "place", F.concat(F.lit("  "), "name", F.lit(" ("), "n", F.lit(f" {unit}) - "), "path").alias("line"))
    return dirs.unionByName(said("class", 15, "methods")).unionByName(said("function", 10, "lines"))


def write_split(parts: dict[str, DataFrame], folder: str) -> None:
    """A folder of text for each part (lines with their order) and an index of the parts; ranges are written side by side, so
    a part may have any number of lines."""
    spark = next(iter(parts.values())).sparkSession
    for name, df in parts.items():
        order = [c for c in df.columns if c != "line"]
        df.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(f"{folder}/{name}")
    spark.createDataFrame([(f"- [{name}]({name})",) for name in parts], "line string").coalesce(1).write.mode("overwrite").text(f"{folder}/index")


def write(lines: DataFrame, path: str) -> None:
    """One text file in the lines' order (reports are bounded by their limits; full listings go section by section)."""
    lines.coalesce(1).write.mode("overwrite").text(path)
