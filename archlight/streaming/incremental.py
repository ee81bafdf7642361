"""The pipeline over arriving records: each micro-batch is routed, analysed and appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from archlight.functions import predicates as P
from archlight.functions import schema as S
from archlight.functions import tasks
from archlight.sources import bucket_store


def route(batch: DataFrame) -> DataFrame:
    """Unfinished records that some model takes, with the tasks they need and the model's name."""
    open_ = batch.where(F.col("status") != S.COMPLETE).withColumn("model", P.model_of()).where("model is not null")
    return open_.withColumn("analysis_tasks", tasks.ensure(P.has_text()))


def run(spark: SparkSession, source: str, target: str, checkpoint: str, analyze: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Processes what has arrived since the last run, then stops; a batch that is run again writes to its own folder, so nothing is doubled."""
    arriving = spark.readStream.schema(S.MANIFEST).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        analyze(route(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(spark: SparkSession, source: str, base: str, checkpoint: str, every: str | None = None, keep: int = 2) -> StreamingQuery:
    """Keeps the catalog at rest up to date: what has arrived is upserted by path, every so often or once.

    The last record of a path wins. A batch rewrites only the buckets that its paths fall into, and versions but the
    newest ``keep`` are removed. A batch that is run again after a failure gives the same catalog, so no record is lost
    or doubled; readers see whole versions only.
    """
    arriving = spark.readStream.schema(S.MANIFEST).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        bucket_store.upsert(batch, base, ["file_path"], ["last_modified", "status"])
        bucket_store.vacuum(spark, base, keep)

    stream = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def task_counts(spark: SparkSession, source: str, window: str = "10 minutes") -> DataFrame:
    """Files by window of their modification time and status, for late records up to the window's length."""
    arriving = spark.readStream.schema(S.MANIFEST).parquet(source).withColumn("ts", F.timestamp_seconds("last_modified"))
    return arriving.withWatermark("ts", window).groupBy(F.window("ts", window), "status").agg(F.count(F.lit(1)).alias("n"))
