"""Source trees: listing, exclusion, languages, decoding, slices.

Listing and exclusion read only paths, sizes and times (``binaryFile`` without its content column); contents are read for
the files that stay.
"""

from __future__ import annotations

import fnmatch
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_FILE_BYTES = 5 * 1024 * 1024

# Languages by file name ending.
EXTENSIONS = {".py": "python", ".java": "java", ".cs": "csharp", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript"}

# Folders that hold no source of the project's own; callers may give other lists.
EXCLUDED_DIRS = """
.git .svn .hg .bzr node_modules __pycache__ .pytest_cache .mypy_cache venv env .venv site-packages dist-packages
dist build target bin obj out output Debug Release x64 x86 bin64 vendor third_party third-party 3rdparty packages Packages
package lib libs libraries external extern deps dependencies .gradle .idea .settings .classpath .project gen generated pkg
go/pkg nuget .nuget bower_components jspm_packages .next .nuxt .output .svelte-kit .astro __tests__ test tests __mocks__
__fixtures__ .storybook storybook-static .cypress cypress .playwright playwright public static assets types @types typings
examples example demo docs Pods .bundle vendor/bundle cache .cache tmp temp logs .vscode .vs
""".split()

# Files that are built, tests, settings, media or documents.
EXCLUDED_FILES = """
*.pyc *.pyo *.pyd *.so *.dll *.dylib *.exe *.bin *.class *.jar *.war *.ear *.obj *.o *.a *.lib *.pdb *.exe.config
*.min.js *.min.css *.map *.bundle.js *.chunk.js *.chunk.css runtime*.js vendor*.js
*.d.ts *.test.js *.test.ts *.test.tsx *.test.jsx *.spec.js *.spec.ts *.spec.tsx *.spec.jsx *.e2e.js *.e2e.ts *.cy.js *.cy.ts
webpack*.js vite*.js rollup*.js esbuild*.js babel.config.js .babelrc.js jest.config.js vitest.config.js vitest.config.ts
*.config.js *.config.ts *.conf.js *.conf.ts *polyfill*.js es5-shim*.js es6-shim*.js
*.svg *.png *.jpg *.jpeg *.gif *.ico *.pdf *.bmp *.tiff *.webp *.mp3 *.mp4 *.md *.rst *.txt *.docx *.xlsx *.pptx
*.json *.yml *.yaml *.xml *.ini *.config *.lock package-lock.json yarn.lock pnpm-lock.yaml
*.log *.tmp *.bak *.swp *.swo *.backup
""".split()


def language_of(path: Column) -> Column:
    """The language of a file name's ending, ``unknown`` if it has none."""
    ending = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair]), F.nullif(ending, F.lit(""))), F.lit("unknown"))


def any_pattern(patterns: list[str]) -> str:
    """One regular expression for shell patterns, to be matched against a whole text."""
    return "^(?:" + "|".join(re.sub(r"\\[zZ]$", "", fnmatch.translate(p)).removeprefix("(?s:").removesuffix(")") for p in patterns) + ")$" if patterns else "(?!)"


def in_excluded_dir(relative: Column, patterns: list[str]) -> Column:
    """Whether a folder on the way to the file has an excluded name or, for patterns with a slash, is an excluded path."""
    names = [p for p in patterns if "/" not in p]
    paths = [p for p in patterns if "/" in p]
    parts = F.split(relative, "/")
    by_name = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: d.rlike(any_pattern(names)))
    return by_name | F.concat(F.lit("/"), relative).rlike("|".join(f"/{re.escape(p)}/" for p in paths) or "(?!)")


def scan(spark: SparkSession, root: str, dirs: list[str] = EXCLUDED_DIRS, files: list[str] = EXCLUDED_FILES, most: int = MAX_FILE_BYTES) -> DataFrame:
    """All files under ``root`` with ``reason``: why one is left out (``dir``, ``pattern``, ``size``, ``language``), or null."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    relative = F.regexp_replace("path", "^.*?" + re.escape(base) + "/", "")
    rows = listed.select("path", relative.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    name = F.substring_index("relative_path", "/", -1)
    rows = rows.withColumn("language", language_of(F.col("relative_path")))
    reason = F.when(in_excluded_dir(F.col("relative_path"), dirs), "dir").when(name.rlike(any_pattern(files)), "pattern").when(F.col("size") > most, "size").when(F.col("language") == "unknown", "language")
    return rows.withColumn("reason", reason)


def scan_statistics(scanned: DataFrame) -> DataFrame:
    """The number of files by reason (null: kept) and language."""
    return scanned.groupBy("reason", "language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of bytes in the first encoding that fits."""

    def one(data: bytes) -> str | None:
        for encoding in ("utf-8", "gbk", "gb2312", "latin-1"):
            try:
                return data.decode(encoding)
            except UnicodeDecodeError:
                continue
        return None

    return content.map(one, na_action="ignore")


def sources(spark: SparkSession, root: str, **options) -> DataFrame:
    """relative_path, language, size, modified, text of the files that stay."""
    kept = scan(spark, root, **options).where("reason IS NULL").select("path", "relative_path", "language", "size", "modified")
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    text = F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8")).otherwise(decoded("content"))
    return kept.join(contents, "path").select("relative_path", "language", "size", "modified", text.alias("text"))


def numbered_lines(files: DataFrame, most: int | None = None) -> DataFrame:
    """(path columns, line, code): a row per line of ``text``, the first ``most`` only if given."""
    lines = F.split("text", "\r?\n", -1)
    lines = lines if most is None else F.slice(lines, 1, most)
    rest = [c for c in files.columns if c != "text"]
    return files.select(*rest, F.posexplode(lines).alias("pos", "code")).select(*rest, (F.col("pos") + 1).alias("line"), "code")


def module_at(modules: DataFrame, path: str, root: str = "") -> DataFrame:
    """The module of an absolute path (under ``root``) or a relative one, separators as they come."""
    wanted = path.replace("\\", "/")
    own = F.translate("relative_path", "\\", "/")
    return modules.where((own == wanted) | (F.concat(F.lit(root.replace("\\", "/").rstrip("/") + "/"), own) == wanted)).limit(1)


def matches_path(path: Column, wanted: Column) -> Column:
    """Whether a path contains the wanted one or has the same file name; no wanted path matches all."""
    want = F.translate(wanted, "\\", "/")
    same = F.substring_index(want, "/", -1) == F.substring_index(F.translate(path, "\\", "/"), "/", -1)
    return F.coalesce(want, F.lit("")).eqNullSafe("") | F.contains(path, want) | same


def resolved(files: DataFrame, path: str) -> DataFrame:
    """The file of a path: the exact one, else one that is equal with other separators, else one with the same name."""
    want = path.replace("\\", "/")
    own = F.translate("relative_path", "\\", "/")
    rank = F.when(F.col("relative_path") == path, 0).when(own == want, 1).when(F.substring_index(own, "/", -1) == want.rpartition("/")[2], 2)
    return files.withColumn("__rank", rank).where("__rank IS NOT NULL").orderBy("__rank", "relative_path").limit(1).drop("__rank")


def sliced(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` of a text."""
    return F.array_join(F.slice(F.split(text, "\n", -1), start, F.greatest(end - start + 1, F.lit(0))), "\n")
