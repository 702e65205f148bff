"""Source trees as a data source: ``spark.read.format("source_tree")``.

Folders that are excluded are seen as names in their parent's listing and never listed themselves. The driver lists only the
uppermost folders, until there are enough to deal out; each task walks its own folders. Suffixes, sizes and beginnings of paths
that a query asks for are pushed into the walk, so that contents are read for wanted files only.

A row is a file or an excluded folder (``kind``), with ``reason``: null if it stays, else ``dir``, ``pattern``, ``size`` or
``language``. Local trees are read as files, others by what pyarrow knows of their address (``hdfs://``, ``s3://``, ``gs://``).

Defined results: a missing root is an error; an empty one has no rows; links to folders are not followed; files that vanish or
can't be read while the walk goes on are left out, as are folders. Content is null for what doesn't stay and without the option
``content``.
"""

from __future__ import annotations

import datetime
import fnmatch
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from .files import EXCLUDED_DIRS, EXCLUDED_FILES, EXTENSIONS, MAX_FILE_BYTES, decoded

SCHEMA = "kind string, path string, relative_path string, suffix string, size bigint, modified timestamp, reason string, content binary"
#: Folders that the driver lists at most before it deals them out.
LISTED_BY_DRIVER = 1000
#: Bytes of contents that a task holds at once, besides one file.
BATCH_BYTES = 8 << 20


@dataclass(frozen=True)
class Entry:
    """A file or folder of a listing."""

    name: str
    folder: bool
    size: int
    modified: float


def whole(patterns: list[str]) -> re.Pattern:
    """One expression for all shell patterns."""
    return re.compile("|".join(fnmatch.translate(p) for p in patterns) or "(?!)")


class Rules:
    """What of a tree is left out."""

    def __init__(self, dirs: list[str], files: list[str], most: int, endings: list[str]) -> None:
        self.by_name, self.files, self.most, self.endings = whole(dirs), whole(files), most, set(endings)
        self.by_path = whole([x for d in dirs for x in (d, f"{d}/*", f"*/{d}/*")])
        self.inside = whole([f"*/{d}/*" for d in dirs])

    def excluded(self, relative: str) -> bool:
        """Whether a folder is left out, by its name or its path."""
        return bool(self.by_name.match(relative.rpartition("/")[2]) or self.by_path.match(relative))

    def reason(self, relative: str, size: int) -> str | None:
        name = relative.rpartition("/")[2]
        if self.inside.match(relative):
            return "dir"
        if self.files.match(name):
            return "pattern"
        if size > self.most:
            return "size"
        return None if suffix_of(name) in self.endings else "language"


def suffix_of(name: str) -> str:
    """The ending of a file name with its dot, in lower case; a name that begins with its only dot has none."""
    return os.path.splitext(name)[1].lower()


class LocalStore:
    """Listing and reading in a mounted file system."""

    def __init__(self, root: str) -> None:
        self.root = root

    def place(self, relative: str) -> str:
        return os.path.join(self.root, relative) if relative else self.root

    def entries(self, relative: str) -> Iterator[Entry]:
        with os.scandir(self.place(relative)) as found:
            for e in found:
                try:
                    is_folder = e.is_dir(follow_symlinks=False)
                    if not is_folder and not e.is_file():
                        continue
                    s = e.stat()
                except OSError:
                    continue
                yield Entry(e.name, is_folder, s.st_size, s.st_mtime)

    def content(self, relative: str) -> bytes:
        with open(self.place(relative), "rb") as f:
            return f.read()

    def exists(self) -> bool:
        return os.path.isdir(self.root)


class RemoteStore:
    """The same by pyarrow's file systems."""

    def __init__(self, address: str) -> None:
        from pyarrow import fs

        self.system, self.root = fs.FileSystem.from_uri(address)
        self.kind = fs.FileType

    def place(self, relative: str) -> str:
        return f"{self.root.rstrip('/')}/{relative}" if relative else self.root

    def entries(self, relative: str) -> Iterator[Entry]:
        from pyarrow import fs

        for i in self.system.get_file_info(fs.FileSelector(self.place(relative))):
            if i.type in (self.kind.File, self.kind.Directory):
                yield Entry(i.base_name, i.type == self.kind.Directory, i.size or 0, i.mtime.timestamp() if i.mtime else 0.0)

    def content(self, relative: str) -> bytes:
        with self.system.open_input_stream(self.place(relative)) as f:
            return f.read()

    def exists(self) -> bool:
        return self.system.get_file_info(self.root).type == self.kind.Directory


def store(address: str) -> LocalStore | RemoteStore:
    parts = urlparse(address)
    if parts.scheme in ("", "file"):
        return LocalStore(unquote(parts.path) if parts.scheme else address)
    return RemoteStore(address)


@dataclass
class Wanted:
    """What pushed filters ask for."""

    suffixes: set[str] | None = None
    least: int = 0
    most: int | None = None
    start: str = ""

    def take(self, f: Filter) -> bool:
        """Whether the walk can apply the filter wholly."""
        column = getattr(f, "attribute", None)
        if column == ("suffix",) and isinstance(f, EqualTo | In):
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.suffixes = asked if self.suffixes is None else self.suffixes & asked
        elif column == ("size",) and isinstance(f, LessThan | LessThanOrEqual):
            bound = f.value - isinstance(f, LessThan)
            self.most = bound if self.most is None else min(self.most, bound)
        elif column == ("size",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.least = max(self.least, f.value + isinstance(f, GreaterThan))
        elif column == ("relative_path",) and isinstance(f, StringStartsWith):
            if not (f.value.startswith(self.start) or self.start.startswith(f.value)):
                self.suffixes = set()  # two different beginnings: nothing
            self.start = max(self.start, f.value, key=len)
        else:
            return False
        return True

    def folder(self, relative: str) -> bool:
        """Whether wanted files can lie below the folder."""
        below = relative + "/" if relative else ""
        return below.startswith(self.start) or self.start.startswith(below)

    def file(self, relative: str, suffix: str | None, size: int | None) -> bool:
        if not relative.startswith(self.start) or self.suffixes is not None and suffix not in self.suffixes:
            return False
        return (size is not None or (self.most is None and not self.least)) and (size is None or self.least <= size <= (size if self.most is None else self.most))


@dataclass
class Folders(InputPartition):
    """Folders of a task: (relative path, whether what lies below belongs to it too)."""

    places: list[tuple[str, bool]]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.address = options["path"]
        self.rules = (json.loads(options.get("dirs", "null")), json.loads(options.get("files", "null")), int(options.get("most", MAX_FILE_BYTES)))
        self.with_content, self.tasks, self.wanted = options.get("content", "false") == "true", int(options.get("tasks", 64)), Wanted()

    def own_rules(self) -> Rules:
        dirs, files, most = self.rules
        return Rules(EXCLUDED_DIRS if dirs is None else dirs, EXCLUDED_FILES if files is None else files, most, list(EXTENSIONS))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Folders]:
        """Level by level, until there are as many folders as tasks; then they are dealt out, their files first."""
        tree, rules = store(self.address), self.own_rules()
        if not tree.exists():
            raise FileNotFoundError(self.address)
        level, own, listed = [""], [], 0
        while level and len(level) < self.tasks and listed + len(level) <= LISTED_BY_DRIVER:
            below = []
            for folder in level:
                names = [f"{folder}/{e.name}" if folder else e.name for e in tree.entries(folder) if e.folder]
                below += [n for n in names if not rules.excluded(n) and self.wanted.folder(n)]
            own += [(folder, False) for folder in level]
            listed += len(level)
            level = sorted(below)
        places = own + [(folder, True) for folder in level]
        return [Folders(places[i :: self.tasks]) for i in range(min(self.tasks, len(places)))]

    def read(self, partition: Folders) -> Iterator[tuple]:
        tree, rules = store(self.address), self.own_rules()
        todo = list(partition.places)
        while todo:
            folder, deep = todo.pop()
            try:
                entries = sorted(tree.entries(folder), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                relative = f"{folder}/{e.name}" if folder else e.name
                if e.folder:
                    if rules.excluded(relative):
                        if self.wanted.file(relative, None, None):
                            yield self.row(tree, "folder", relative, None, None, e.modified, "dir", None)
                    elif deep and self.wanted.folder(relative):
                        todo.append((relative, True))
                    continue
                suffix = suffix_of(e.name)
                if not self.wanted.file(relative, suffix, e.size):
                    continue
                reason, content = rules.reason(relative, e.size), None
                if reason is None and self.with_content:
                    try:
                        content = tree.content(relative)
                    except OSError:
                        continue
                yield self.row(tree, "file", relative, suffix, e.size, e.modified, reason, content)

    @staticmethod
    def row(tree, kind, relative, suffix, size, modified, reason, content) -> tuple:
        return (kind, tree.place(relative), relative, suffix, size, datetime.datetime.fromtimestamp(modified, datetime.UTC), reason, content)


class SourceTree(DataSource):
    """Options: ``path``; ``dirs`` and ``files`` (JSON lists of shell patterns that are left out), ``most`` (bytes), ``content``
    (true or false), ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def walked(spark: SparkSession, root: str, dirs: list[str] = EXCLUDED_DIRS, files: list[str] = EXCLUDED_FILES, most: int = MAX_FILE_BYTES, content: bool = False, tasks: int | None = None) -> DataFrame:
    """The rows of a tree (see ``SCHEMA``)."""
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"dirs": json.dumps(dirs), "files": json.dumps(files), "most": str(most), "content": str(content).lower(), "tasks": str(tasks or spark.sparkContext.defaultParallelism * 4)}
    return spark.read.format("source_tree").options(**options).load(root)


def counters(rows: DataFrame) -> DataFrame:
    """One row: code_files, skipped_dirs, skipped_files. An excluded folder counts once, whatever lies below it."""
    number = lambda condition: F.count(F.when(F.expr(condition), 1))
    return rows.agg(number("reason IS NULL").alias("code_files"), number("kind = 'folder'").alias("skipped_dirs"), number("kind = 'file' AND reason IS NOT NULL").alias("skipped_files"))


def texts(rows: DataFrame) -> DataFrame:
    """relative_path, suffix, size, modified, text of the files that stay, of rows with content."""
    text = F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8")).otherwise(decoded("content"))
    return rows.where("reason IS NULL").select("relative_path", "suffix", "size", "modified", text.alias("text"))


def read_texts(files: DataFrame, root: str) -> DataFrame:
    """The rows of ``files`` (with relative_path) with ``text``: only these are read, each by the task that has its row. Those that
    are gone meanwhile are left out."""

    def read(batches):
        import pyarrow as pa

        tree = store(root)
        for batch in batches:
            paths, contents = [], []
            for relative in batch.column(0).to_pylist():
                try:
                    data = tree.content(relative)
                except OSError:
                    continue
                paths.append(relative)
                contents.append(data)
                if sum(map(len, contents)) > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                    paths, contents = [], []
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    found = files.select("relative_path").mapInArrow(read, "path string, content binary")
    text = F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8")).otherwise(decoded("content"))
    return files.join(found.select(F.col("path").alias("relative_path"), text.alias("text")), "relative_path")


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Write (relative_path, text) as files below ``root``, each task its own rows; (relative_path, size) of what was written.
    Files are replaced, so that a repeated task leaves the same tree."""

    def write(batches):
        import pyarrow as pa

        local = urlparse(root).scheme in ("", "file")
        tree = store(root) if local else RemoteStore(root)
        for batch in batches:
            sizes = []
            for relative, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place, data = tree.place(relative), (text or "").encode()
                if local:
                    os.makedirs(os.path.dirname(place), exist_ok=True)
                    with open(place, "wb") as f:
                        f.write(data)
                else:
                    tree.system.create_dir(place.rpartition("/")[0])
                    with tree.system.open_output_stream(place) as f:
                        f.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["relative_path", "size"])

    return files.select(F.col("relative_path").cast("string"), F.col("text").cast("string")).mapInArrow(write, "relative_path string, size bigint")
