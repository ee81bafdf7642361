"""Tables at rest that take single rows: hash buckets by key, copied on write.

A row's bucket comes from its key's hash. A version names a folder for every bucket; an upsert reads and writes only
the buckets that hold one of the new keys, in new folders, and the next version names these beside the old ones of all
others. A version is a numbered pointer that is never changed; it is put into place by a rename that fails if another
writer was quicker, who then starts again from the newer version. So readers see whole versions only, and of two
writers' rows none are lost. ``vacuum`` removes folders that no kept version names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog_files import hadoop, pointers

BUCKETS = 64
#: How often a writer starts again after another was quicker.
TRIES = 20


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def state(spark: SparkSession, base: str) -> tuple[int, dict]:
    """The newest version's number and what it says; 0 and nothing for a table that is not there."""
    known = pointers(spark, base)
    if not known:
        return 0, {"folders": {}}
    number, path = known[-1]
    return number, json.loads(spark.read.text(path).first()[0])


def put(spark: SparkSession, base: str, number: int, said: dict) -> bool:
    """Publishes a version under a number; false if that is taken."""
    fs, temp = hadoop(spark, f"{base}/.pointer-{uuid.uuid4().hex}")
    out = fs.create(temp, False)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    _, target = hadoop(spark, f"{base}/CURRENT-{number:012d}")
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(temp), fs.makeQualified(target), none)  # fails if the target is there
    except Exception:  # noqa: BLE001  of another kind on every store
        fs.delete(temp, False)
        if not fs.exists(target):
            raise
        return False
    return True


def read(spark: SparkSession, base: str, only: list[int] | None = None) -> DataFrame:
    """The newest version, or some of its buckets."""
    number, said = state(spark, base)
    if not number:
        raise RuntimeError(f"no table under {base}")
    folders = [f for b, f in said["folders"].items() if only is None or int(b) in only]
    if not folders:
        return spark.createDataFrame([], said["schema"])
    return spark.read.schema(said["schema"]).parquet(*(f"{base}/{f}" for f in folders))


def upsert(new: DataFrame, base: str, keys: list[str], order: list[str] = (), buckets: int = BUCKETS) -> list[int]:
    """New rows replace those with their keys; of several with one key the last in ``order`` wins. Gives the buckets that were written.

    The number of buckets is the table's own once it is there. Rows go by bucket and key, so a bucket is written by
    several tasks if it is large, and ``order`` should tell rows of one key apart.
    """
    spark = new.sparkSession
    # by bucket and key throughout, so rows are shuffled once, whichever side they are of
    by = ["_bucket", *keys]
    last = Window.partitionBy(*by).orderBy(*(F.desc_nulls_last(c) for c in order or keys))
    for _ in range(TRIES):
        number, said = state(spark, base)
        of = said.get("buckets", buckets)
        dealt = new.withColumn("_bucket", bucket_of(keys, of))
        touched = sorted(r["_bucket"] for r in dealt.select("_bucket").distinct().collect())  # a number of buckets at most
        rows = dealt.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")
        held = [b for b in touched if str(b) in said["folders"]]
        if held:
            kept = read(spark, base, held).withColumn("_bucket", bucket_of(keys, of)).join(dealt.select(*by), by, "left_anti")
            rows = kept.select(*rows.columns).unionByName(rows)
        version = f"v-{uuid.uuid4().hex}"
        rows.write.partitionBy("_bucket").parquet(f"{base}/{version}")
        folders = said["folders"] | {str(b): f"{version}/_bucket={b}" for b in touched}
        if put(spark, base, number + 1, {"buckets": of, "schema": said.get("schema") or ddl(new), "folders": folders}):
            return touched
        fs, p = hadoop(spark, f"{base}/{version}")
        fs.delete(p, True)
    raise RuntimeError(f"{base}: another writer was quicker {TRIES} times")


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {k}" for n, k in df.dtypes)


def vacuum(spark: SparkSession, base: str, keep: int = 2) -> int:
    """Removes pointers but the newest ones, and folders that none of these names; gives the number of bucket folders removed."""
    known = pointers(spark, base)
    fs, _ = hadoop(spark, base)
    named = {f for _, path in known[-keep:] for f in json.loads(spark.read.text(path).first()[0])["folders"].values()}
    for _, path in known[:-keep]:
        fs.delete(hadoop(spark, path)[1], False)
    removed = 0
    for version in fs.listStatus(hadoop(spark, base)[1]):
        name = version.getPath().getName()
        if not name.startswith("v-"):
            continue
        below = [s.getPath().getName() for s in fs.listStatus(version.getPath()) if s.isDirectory()]
        gone = [b for b in below if f"{name}/{b}" not in named]
        removed += len(gone)
        if len(gone) == len(below):
            fs.delete(version.getPath(), True)
        else:
            for b in gone:
                fs.delete(hadoop(spark, f"{base}/{name}/{b}")[1], True)
    return removed
