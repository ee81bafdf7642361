"""A catalog view over the generated tables, told once for Spark and once for DuckDB.

Each document is a file; labels give its flags, ids give states, tasks and versions by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlight.functions import schema as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
MIMES = ("text/plain", "application/pdf", "image/png", "image/jpeg", "video/mp4", SHEET, "")
#: What the texts of files with an estate end with.
NOTE = " is with the attorney. My bank account has an unreported balance and a penalty."
STATES = {0: S.PENDING_EXTRACTION, 1: S.PENDING_ANALYSIS, 2: S.FAILED}


def by_case(key: Column, cases: dict[int, str], default: str) -> Column:
    out = None
    for k, v in cases.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def task(name: str, status: Column, version: Column) -> Column:
    error = F.when(status == S.TASK_ERROR, "failed").otherwise(F.lit(None).cast("string"))
    return F.struct(F.lit(name).alias("name"), status.alias("status"), error.alias("error_message"), version.cast("int").alias("version"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    labels = table(spark, sf_dir, "labels")
    pick = lambda n, k, a, b: F.when(d % n == k, a).otherwise(b)
    tasks = F.when(d % 11 == 0, F.array().cast(f"array<{S.TASK}>")).otherwise(
        F.array(
            task("text_analysis", pick(4, 0, S.TASK_PENDING, S.TASK_COMPLETE), pick(6, 0, 0, 1)),
            task("people_analysis", pick(3, 0, S.TASK_ERROR, S.TASK_COMPLETE), F.lit(1)),
            task("password_detection", F.lit(S.TASK_COMPLETE), pick(2, 0, 4, 5)),
        )
    )
    entry = lambda item, why: F.create_map(F.lit("item"), F.lit(item) if isinstance(item, str) else item, F.lit("why_it_matters"), F.lit(why))
    estate = F.create_map(F.lit("Legal"), F.array(entry(F.concat(F.lit("Will "), d.cast("string")), "heirs")), F.lit("Financial"), F.array(entry("", ""), entry("Account", "money")))
    secret = F.array(F.struct(F.lit("line 1").alias("context"), F.concat(F.lit("pw"), d.cast("string")).alias("password")))
    return (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .select(
            d.alias("manifest_idx"),
            F.concat(F.lit("/archive/"), "source", F.lit("/"), "lang", F.lit("/"), d.cast("string"), F.lit(".txt")).alias("file_path"),
            F.concat(d.cast("string"), F.lit(".txt")).alias("file_name"),
            by_case(d % 7, dict(enumerate(MIMES[:6])), "").alias("mime_type"),
            F.octet_length("text").cast("long").alias("file_size"),
            (F.lit(1_700_000_000.0) + d * 3600).cast("double").alias("last_modified"),
            F.sha2("text", 256).alias("sha256"),
            by_case(d % 10, STATES, S.COMPLETE).alias("status"),
            F.when(d % 5 == 1, F.concat(F.col("text"), F.lit("\nThe will of file "), d.cast("string"), F.lit(NOTE))).when(d % 5 != 0, F.col("text")).alias("extracted_text"),
            tasks.alias("analysis_tasks"),
            F.when(d % 8 == 1, "").when(d % 8 != 0, F.col("text")).alias("summary"),
            F.when(d % 9 != 0, F.concat(F.lit("File "), d.cast("string"))).alias("description"),
            F.when(d % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("user"), (d % 13).cast("string")), F.concat(F.lit(" User "), (d % 5).cast("string")), F.lit(" "), F.concat(F.lit("user"), (d % 13).cast("string")))).alias("mentioned_people"),
            (F.col("toxic") == 1).alias("is_nsfw"),
            (F.col("quality") == 0).alias("has_financial_red_flags"),
            F.when(d % 6 == 0, True).when(d % 6 == 1, False).alias("contains_password"),
            F.when((d % 6 == 0) | (d % 6 == 2), secret).otherwise(F.array().cast(f"array<{S.PASSWORD}>")).alias("passwords"),
            F.when(d % 5 == 1, True).alias("has_estate_relevant_info"),
            F.when(d % 5 == 1, estate).otherwise(F.from_json(F.lit("{}"), S.ESTATE)).alias("estate_information"),
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a vector table; labels give the types."""
    v, k = F.col("vec_id"), F.col("label")
    mime = by_case(k % 4, dict(enumerate(MIMES[:4])), "")
    meta = F.struct(
        F.concat(F.lit("/vectors/"), v.cast("string")).alias("file_path"), F.concat(F.lit("v"), v.cast("string")).alias("file_name"), mime.alias("mime_type"), F.split_part(mime, F.lit("/"), F.lit(1)).alias("file_type"),
        (v % 5 == 0).alias("is_nsfw"), (v % 3 == 0).alias("has_financial_red_flags"), F.lit(False).alias("has_estate_relevant_info"),
    )
    return table(spark, sf_dir, "embeddings").select(v.alias("id"), "embedding", "label", meta.alias("metadata"))


QUERY_VECTOR = [round(0.05 * ((i * 7) % 11 - 5), 2) for i in range(64)]


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


_TASKS = """CASE WHEN doc_id % 11 = 0 THEN [] ELSE [
  {'name': 'text_analysis', 'status': CASE WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'complete' END, 'version': CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 1 END},
  {'name': 'people_analysis', 'status': CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'complete' END, 'version': 1},
  {'name': 'password_detection', 'status': 'complete', 'version': CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 5 END}] END"""

#: The catalog view for DuckDB, as the relation ``m``.
MANIFEST_SQL = f"""WITH m AS (
SELECT doc_id AS manifest_idx, '/archive/' || source || '/' || lang || '/' || doc_id || '.txt' AS file_path, doc_id || '.txt' AS file_name,
  CASE doc_id % 7 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/jpeg' WHEN 4 THEN 'video/mp4' WHEN 5 THEN '{SHEET}' ELSE '' END AS mime_type,
  strlen(text) AS file_size, 1700000000.0 + doc_id * 3600 AS last_modified, sha256(text) AS sha256,
  CASE doc_id % 10 WHEN 0 THEN 'pending_extraction' WHEN 1 THEN 'pending_analysis' WHEN 2 THEN 'failed' ELSE 'complete' END AS status,
  CASE WHEN doc_id % 5 = 1 THEN text || chr(10) || 'The will of file ' || doc_id || '{NOTE}' WHEN doc_id % 5 <> 0 THEN text END AS extracted_text, {_TASKS} AS analysis_tasks,
  CASE WHEN doc_id % 8 = 0 THEN NULL WHEN doc_id % 8 = 1 THEN '' ELSE text END AS summary,
  CASE WHEN doc_id % 9 <> 0 THEN 'File ' || doc_id END AS description,
  CASE WHEN doc_id % 4 = 0 THEN [] ELSE ['user' || (doc_id % 13), ' User ' || (doc_id % 5), ' ', 'user' || (doc_id % 13)] END AS mentioned_people,
  toxic = 1 AS is_nsfw, quality = 0 AS has_financial_red_flags,
  CASE WHEN doc_id % 6 = 0 THEN true WHEN doc_id % 6 = 1 THEN false END AS contains_password,
  doc_id % 6 IN (0, 2) AS has_password_rows, doc_id % 5 = 1 AS has_estate, regexp_extract('/archive/' || source || '/' || lang || '/' || doc_id || '.txt', '^(.*)/[^/]*$', 1) AS directory
FROM documents LEFT JOIN labels USING (doc_id))
"""
