"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes in an Arrow batch. Texts may be long, so the row bound is low and a byte bound stands beside it.
ARROW_ROWS = 2_000
ARROW_BYTES = 16 << 20
BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches, whatever the length of a row.

    The bounds are settings of the session that a plan reads where it runs, so they are set where a frame is made and
    only lowered: a caller's smaller batches stay.
    """
    for name, most in BOUNDS.items():
        own = spark.conf.get(name, most)
        if not own.isdigit() or not 0 < int(own) <= int(most):
            spark.conf.set(name, most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on one machine, where the session names none."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="archlight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: What this driver has put into the shared folder and not yet removed.
MADE: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/archlight-{name}-{uuid.uuid4().hex}"
    MADE.add(path)
    return path


def settle(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes a frame into the shared folder and reads it back, which cuts its lineage for good."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    MADE.discard(path)


def forget(*frames: DataFrame) -> None:
    """Removes the files of settled frames that are read no more."""
    for df in frames:
        remove(df.sparkSession, df._settled)


def release(spark: SparkSession) -> int:
    """Removes all that this driver has left in the shared folder, once the results that read it are written; gives the number of tables."""
    left = list(MADE)
    for path in left:
        remove(spark, path)
    return len(left)
