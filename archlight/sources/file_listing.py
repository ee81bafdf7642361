"""A listing of directory trees as a Spark data source: partitions are directories, predicates prune them.

Roots are local (on a mount that every executor sees) or URIs of a store that Arrow reaches. Of the pushed predicates
those on ``path`` leave out directories that cannot hold a match before they are listed, on the driver and in tasks;
those on ``path``, ``size`` and ``modified`` leave out files before anything opens them.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

NAME = "archlight_files"
LISTED = "path string, size long, modified double, readable boolean"
COLUMNS = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.float64()), ("readable", pa.bool_())])
#: Files in an Arrow batch.
BATCH = 10_000

File = tuple[str, int, float, bool]


def local(root: str) -> bool:
    return "://" not in root and not root.startswith("file:")


def entries(path: str) -> tuple[list[str], list[File]]:
    """Directories and files right below a directory, by name; one that cannot be read holds nothing."""
    return local_entries(path) if local(path) else store_entries(path)


def local_entries(path: str) -> tuple[list[str], list[File]]:
    below, found = [], []
    try:
        with os.scandir(path) as listed:
            for e in sorted(listed, key=lambda e: e.name):
                if e.is_dir(follow_symlinks=False):
                    below.append(e.path)
                elif e.is_file():
                    s = e.stat()
                    found.append((e.path, s.st_size, s.st_mtime, os.access(e.path, os.R_OK)))
    except OSError:
        pass
    return below, found


def store_entries(path: str) -> tuple[list[str], list[File]]:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
    below, found = [], []
    for i in sorted(store.get_file_info(fs.FileSelector(inner, allow_not_found=True)), key=lambda i: i.path):
        if i.type == fs.FileType.Directory:
            below.append(head + i.path)
        elif i.type == fs.FileType.File:
            found.append((head + i.path, i.size, i.mtime_ns / 1e9 if i.mtime_ns else 0.0, True))
    return below, found


@dataclass
class Wanted:
    """The pushed predicates: bounds of sizes and times, and the paths or the prefixes that match."""

    tests: list[tuple[str, Callable, object]] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)

    def take(self, f: Filter) -> bool:
        """Whether the predicate is one that the listing can apply itself."""
        column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        if column == "path" and isinstance(f, StringStartsWith):
            self.prefixes.append(f.value)
        elif column == "path" and isinstance(f, EqualTo):
            self.names.append([f.value])
        elif column == "path" and isinstance(f, In):
            self.names.append(list(f.value))
        elif column in ("size", "modified") and type(f) in COMPARED:
            self.tests.append((column, COMPARED[type(f)], f.value))
        else:
            return False
        return True

    def may_hold(self, directory: str) -> bool:
        below = directory.rstrip("/") + "/"
        return all(below.startswith(p) or p.startswith(below) for p in self.prefixes) and all(any(n.startswith(below) for n in some) for some in self.names)

    def matches(self, file: File) -> bool:
        path, size, modified, _ = file
        value = {"size": size, "modified": modified}
        return all(path.startswith(p) for p in self.prefixes) and all(path in some for some in self.names) and all(test(value[c], bound) for c, test, bound in self.tests)


COMPARED: dict[type, Callable] = {
    GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b,
}


@dataclass
class Tree(InputPartition):
    """Directories to walk to their end, or files of the upper levels that are listed already."""

    root: list[str] | None
    files: list[File] = field(default_factory=list)


class Reader(DataSourceReader):
    def __init__(self, root: str, enough: int) -> None:
        self.root, self.enough, self.wanted = root, enough, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        """Upper levels are listed here until there are enough directories; these are dealt to so many partitions."""
        waiting, found = [self.root], []
        while waiting and len(waiting) < self.enough:
            below = []
            for d in waiting:
                dirs, files = entries(d)
                below += filter(self.wanted.may_hold, dirs)
                found += filter(self.wanted.matches, files)
            waiting = below
        return [*(Tree(None, found[i : i + BATCH]) for i in range(0, len(found), BATCH)), *(Tree(waiting[k :: self.enough]) for k in range(min(self.enough, len(waiting))))] or [Tree(None)]

    def walk(self, roots: list[str]) -> Iterator[File]:
        waiting = list(roots)
        while waiting:
            dirs, files = entries(waiting.pop())
            waiting += filter(self.wanted.may_hold, dirs)
            yield from filter(self.wanted.matches, files)

    def read(self, partition: Tree) -> Iterator[pa.RecordBatch]:
        held: list[File] = []
        for f in partition.files if partition.root is None else self.walk(partition.root):
            held.append(f)
            if len(held) == BATCH:
                yield told(held)
                held = []
        if held:
            yield told(held)


def told(held: list[File]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), COLUMNS)], schema=COLUMNS)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("partitions", "1")))


def list_files(spark: SparkSession, root: str, condition: Column | None = None) -> DataFrame:
    """``path, size, modified, readable`` of all files under a root, hidden and empty ones too, for which the condition holds.

    Only this condition is pushed into the source: Spark keeps what it pushed into a Python source for all queries over
    one load, so each call loads for itself and what follows stays outside. The session's setting for pushing
    predicates into Python sources is switched on, as it is read when a query is planned.
    """
    if local(root) and not os.path.isdir(root):
        raise ValueError(f"no directory: {root}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Files)
    found = spark.read.format(NAME).option("path", root).option("partitions", 4 * spark.sparkContext.defaultParallelism).load()
    return (found if condition is None else found.where(condition)).mapInArrow(lambda batches: batches, LISTED)


def opened(path: str):
    """A file's bytes as a stream."""
    if local(path):
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inner)


@contextmanager
def created(path: str):
    """A new file as a stream; it appears under its name, in the place of a former one, once it is whole."""
    folder, name = path.rsplit("/", 1)
    temp = f"{folder}/.{name}-{uuid.uuid4().hex}"
    if local(path):
        os.makedirs(folder, exist_ok=True)
        with open(temp, "wb") as f:
            yield f
        os.replace(temp, path)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    held = inner.rsplit("/", 1)[0]
    store.create_dir(held)
    staged = f"{held}/{temp.rsplit('/', 1)[1]}"
    with store.open_output_stream(staged) as f:
        yield f
    store.move(staged, inner)
