"""Tables as one file of any store: written in parts by tasks, then joined in order and put in place by a rename.

Tasks write their parts by Spark's writers, whose commit lets only whole parts through. The driver joins them by the
store's own concatenation, or by streaming through a small buffer where the store has none, under another name. The
last step is a rename over the target: readers see the former file or the new one, whole, and a job that fails leaves
the former. Before that, nothing of the target is touched.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUFFER = 1 << 20


class Store:
    """The few file operations that a commit needs, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.hadoop = self.jvm.org.apache.hadoop
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, name: str):
        return self.hadoop.fs.Path(name)

    def parts(self, folder: str) -> list:
        """Parts with data, in order."""
        found = [s for s in self.fs.listStatus(self.path(folder)) if s.getPath().getName().startswith("part-") and s.getLen()]
        return [s.getPath() for s in sorted(found, key=lambda s: s.getPath().getName())]

    def write(self, target, head: bytes, sources: list, skip: int, tail: bytes) -> None:
        """A file of a head, the sources (the first without its first bytes) and a tail, through one buffer."""
        out = self.fs.create(target, True)
        try:
            out.write(bytearray(head))
            for k, source in enumerate(sources):
                stream = self.fs.open(source)
                try:
                    if k == 0 and skip:
                        stream.seek(skip)
                    self.hadoop.io.IOUtils.copyBytes(stream, out, BUFFER, False)
                finally:
                    stream.close()
            out.write(bytearray(tail))
        finally:
            out.close()

    def concatenated(self, target, sources: list) -> bool:
        """Whether the store has joined the sources to the target itself."""
        array = self.gateway.new_array(self.hadoop.fs.Path, len(sources))
        for k, source in enumerate(sources):
            array[k] = source
        try:
            self.fs.concat(target, array)
        except UnsupportedOperationException:  # as Spark tells Java's own
            return False
        except Py4JJavaError as e:
            if "UnsupportedOperationException" in str(e.java_exception):
                return False
            raise
        return True

    def replace(self, source, target) -> None:
        options = self.gateway.new_array(self.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self.hadoop.fs.Options.Rename, "OVERWRITE")
        self.hadoop.fs.FileContext.getFileContext(source.toUri() if source.toUri().getScheme() else self.fs.getUri(), self.conf).rename(source, target, options)


def publish(spark: SparkSession, path: str, write_parts, head: bytes, tail: bytes, skip: int = 0) -> None:
    """One file at ``path`` from the parts that ``write_parts(folder)`` writes; ``skip`` bytes of the first go."""
    store = Store(spark, path)
    target = store.fs.makeQualified(store.path(path))
    folder = f"{target.getParent().toString()}/.{target.getName()}-{uuid.uuid4().hex}"
    staged = store.path(f"{folder}/whole")
    try:
        write_parts(f"{folder}/parts")
        parts = store.parts(f"{folder}/parts")
        store.write(staged, head, parts[:1], skip, b"")
        if len(parts) > 1:
            end = store.path(f"{folder}/tail")
            store.write(end, tail, [], 0, b"")
            if not store.concatenated(staged, [*parts[1:], end]):
                store.write(staged, head, parts, skip, tail)
        else:
            store.write(staged, head, parts, skip, tail)
        store.replace(staged, target)
    finally:
        store.fs.delete(store.path(folder), True)


def write_json(df: DataFrame, path: str, order: list[str], columns: list[str] | None = None) -> None:
    """The rows in order as one JSON array of objects with the columns, all if none are named; no row gives an empty array."""
    row = F.struct(*(F.col(f"`{c}`") for c in columns or df.columns))
    lines = df.orderBy(*order).select(F.concat(F.lit(","), F.to_json(row)))
    publish(df.sparkSession, path, lines.write.text, b"[\n", b"]\n", skip=1)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """The rows in order as one CSV file with a header and all fields quoted; nested fields as JSON."""
    kinds = dict(df.dtypes)
    flat = df.orderBy(*order).select(*(F.to_json(F.col(f"`{c}`")).alias(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c in df.columns))
    head = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns) + "\n"
    publish(df.sparkSession, path, flat.write.options(quoteAll="true", escape='"', emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv, head.encode(), b"")
