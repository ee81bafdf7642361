"""Vector search, chat history, context packing and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from archlight.functions import predicates as P
from archlight.operators import catalog as C
from archlight.operators import retrieval as R
from archlight.operators import vector_index
from archlight.sources import bucket_store
from archlight.sources.catalog_tables import MANIFEST_SQL as M
from archlight.sources.catalog_tables import QUERY_VECTOR, chat, manifest, table, vectors
from archlight.sources.shared import shared_path

from .registry import query

VECTOR = "[" + ", ".join(map(str, QUERY_VECTOR)) + "]::DOUBLE[]"
DISTANCE = f"list_sum(list_transform(list_zip(embedding::DOUBLE[], {VECTOR}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
NEAREST = f"SELECT vec_id AS id, round({DISTANCE}, 6) AS distance, round(1 - {DISTANCE}, 6) AS relevance FROM embeddings "


def shown(df):
    return df.select("id", F.round("distance", 6).alias("distance"), F.round("relevance", 6).alias("relevance"))


@query(NEAREST + f"ORDER BY {DISTANCE}, vec_id LIMIT 3")
def vector_topk(spark, sf):
    return shown(R.top_k(vectors(spark, sf), QUERY_VECTOR))


@query(NEAREST + f"WHERE vec_id % 5 <> 0 AND label % 4 IN (0, 1) ORDER BY {DISTANCE}, vec_id LIMIT 5")
def vector_topk_filtered(spark, sf):
    return shown(R.top_k(vectors(spark, sf), QUERY_VECTOR, R.CLI_K, P.vector_filter(hide_nsfw=True, mime_types=("text/plain", "application/pdf"))))


@query("WITH p AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), a AS (SELECT label, pos, round(avg(x), 5) AS x FROM p GROUP BY 1, 2) SELECT label, pos - 1 AS pos, x FROM a")
def embedding_mean(spark, sf):
    pooled = R.mean_pool(table(spark, sf, "embeddings"), "label")
    return pooled.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("x"))


ESTATE = """CASE WHEN has_estate THEN '{"Legal":[{"item":"Will ' || manifest_idx || '","why_it_matters":"heirs"}],"Financial":[{"item":"","why_it_matters":""},{"item":"Account","why_it_matters":"money"}]}' END"""


@query(M + f"SELECT file_path AS id, split_part(mime_type, '/', 1) AS file_type, trim(concat_ws(' ', file_name, nullif(summary, ''), description, nullif(extracted_text, ''), nullif(array_to_string(mentioned_people, ', '), ''), {ESTATE})) AS document FROM m")
def vector_documents(spark, sf):
    return manifest(spark, sf).select(F.col("file_path").alias("id"), R.metadata()["file_type"].alias("file_type"), R.document_text().alias("document"))


TYPES = "SELECT CASE label % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png' ELSE 'image/jpeg' END AS mime_type, count(*) AS n FROM embeddings GROUP BY 1"


@query(f"SELECT mime_type, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM ({TYPES})")
def db_stats(spark, sf):
    return C.db_stats(vectors(spark, sf))


@query(M + "SELECT file_path, mime_type, CASE WHEN trim(coalesce(summary, '')) <> '' THEN summary ELSE coalesce(description, summary) END AS summary, coalesce(is_nsfw, false) AS is_nsfw, coalesce(has_financial_red_flags, false) AS has_financial_red_flags FROM m")
def db_files(spark, sf):
    m = manifest(spark, sf)
    return C.db_files(m.select(R.metadata().alias("metadata")), m)


@query(M + "SELECT file_path, mime_type, CASE WHEN trim(coalesce(summary, '')) <> '' THEN summary ELSE coalesce(description, summary) END AS summary FROM m")
def stats_summary_fallback(spark, sf):
    m = manifest(spark, sf)
    return C.with_summaries(m.select(R.metadata().alias("metadata")), m)


@query("SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{p}')" for p in P.STATS_PHRASES) + " AS is_stats FROM conversations")
def intent_router(spark, sf):
    return chat(spark, sf).select("conv_id", "turn", P.asks_for_stats(F.col("text")).alias("is_stats"))


LINE = "role || ': ' || CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END"
PAST = f"coalesce(string_agg({LINE}, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '')"


@query(f"SELECT conv_id, turn, {PAST} AS history FROM conversations")
def chat_history(spark, sf):
    return R.history(chat(spark, sf)).select("conv_id", "turn", "history")


def entries(spark, sf):
    """Documents of a source in the order of their ids, as entries of a context."""
    return table(spark, sf, "documents").select("source", "doc_id", R.snippet(F.col("text"), R.SNIPPET_CHARS).alias("entry"))


PACKED = """WITH r AS (SELECT source, doc_id, CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || '...' ELSE text END AS entry, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE text <> ''),
c AS (SELECT *, sum(length(entry)) OVER (PARTITION BY source ORDER BY place) AS running_chars FROM r), k AS (SELECT * FROM c WHERE place = 1 OR running_chars <= 2000) """


@query(PACKED + "SELECT source, doc_id, CAST(place AS INT) AS place, CAST(running_chars AS BIGINT) AS running_chars FROM k")
def context_packing(spark, sf):
    return R.pack_context(entries(spark, sf), "source", "doc_id", "entry").select("source", "doc_id", "place", "running_chars")


@query(
    PACKED + f", x AS (SELECT source, string_agg(entry, chr(10) ORDER BY place) AS context FROM k GROUP BY source), h AS (SELECT conv_id, turn, text, 'src' || conv_id % 20 AS source, {PAST} AS history FROM conversations) "
    "SELECT conv_id, turn, CASE WHEN history <> '' THEN 'Earlier turns:' || chr(10) || history || chr(10) || chr(10) ELSE '' END || 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM h LEFT JOIN x USING (source)"
)
def rag_prompt(spark, sf):
    packed = R.pack_context(entries(spark, sf), "source", "doc_id", "entry")
    context = packed.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"]), "\n").alias("context"))  # of bounded length
    asked = R.history(chat(spark, sf)).withColumn("source", F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")))  # each conversation asks about one source
    return asked.join(context, "source", "left").select("conv_id", "turn", R.prompt(F.col("text"), F.col("context"), F.col("history")).alias("prompt"))


@query(
    f"WITH c AS ({TYPES}), f AS (SELECT 'Not safe for work' AS name, count(*) FILTER (vec_id % 5 = 0) AS n FROM embeddings UNION ALL SELECT 'Red flags', count(*) FILTER (vec_id % 3 = 0) FROM embeddings) "
    "SELECT (SELECT 'Total files: ' || sum(n)::BIGINT || chr(10) || string_agg(mime_type || ': ' || n, chr(10) ORDER BY mime_type) FROM c) || chr(10) || (SELECT string_agg(name || ': ' || n, chr(10) ORDER BY name) FROM f WHERE n > 0) AS answer"
)
def stats_answer(spark, sf):
    v = vectors(spark, sf)
    counts = v.agg(F.count_if("metadata.is_nsfw").alias("a"), F.count_if("metadata.has_financial_red_flags").alias("b"))
    flags = counts.select(F.explode(F.array(F.struct(F.lit("Not safe for work").alias("name"), F.col("a").alias("n")), F.struct(F.lit("Red flags").alias("name"), F.col("b").alias("n")))).alias("f")).select("f.*")
    return R.stats_answer(C.db_stats(v).drop("total"), flags)


@query("SELECT conv_id, turn, CAST(len(range(0, length(text), greatest(floor(turn * 10.0), 1)::BIGINT)) AS INT) AS n_frames FROM conversations")
def frame_selection(spark, sf):
    """A turn's text stands for a film: its characters are frames, its number the frames a second."""
    return chat(spark, sf).select("conv_id", "turn", F.size(R.selected_frames(F.length("text"), F.col("turn").cast("double"))).alias("n_frames"))


@query(M + "SELECT manifest_idx, CASE WHEN lang = 'fr' OR source = 'src1' THEN true ELSE is_nsfw END AS is_nsfw FROM (SELECT m.*, d.lang, d.source FROM m JOIN documents d ON d.doc_id = m.manifest_idx)")
def frames_nsfw(spark, sf):
    """Parts of a file's path stand for the classes of its frames: some are not safe in French and of source 1."""
    parts = F.split("file_path", "/")
    label = lambda part, word: F.when(part == word, "NSFW").otherwise("sfw")
    return manifest(spark, sf).select("manifest_idx", R.any_frame_nsfw(F.array(F.lit("SFW"), label(F.get(parts, F.lit(3)), "fr"), label(F.get(parts, F.lit(2)), "src1")), F.col("is_nsfw")).alias("is_nsfw"))


@query("SELECT vec_id AS id, CASE WHEN label = 3 THEN 99 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, 99 FROM embeddings WHERE label = 5")
def vector_upsert(spark, sf):
    old = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    new = old.where("label = 3").select("id", F.lit(99).alias("label")).unionByName(old.where("label = 5").select((F.col("id") + 1_000_000).alias("id"), F.lit(99).alias("label")))
    return R.upsert(old, new)


@query("SELECT vec_id AS id, CASE WHEN vec_id % 97 = 5 THEN 99 ELSE label END AS label, embedding[1]::DOUBLE + CASE WHEN vec_id % 97 = 5 THEN 1 ELSE 0 END AS head FROM embeddings UNION ALL SELECT 1000000 + label, 100 + max(vec_id), 0 FROM embeddings GROUP BY label")
def vector_store(spark, sf):
    """A vector table at rest: written once, then single rows replaced and added, the last of equal keys; only their buckets are written anew."""
    base = shared_path(spark, "vectors")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.get("embedding", F.lit(0)).cast("double").alias("head"))
    bucket_store.upsert(e, base, ["id"])
    bucket_store.upsert(e.where("id % 97 = 5").select("id", F.lit(99).alias("label"), (F.col("head") + 1).alias("head")), base, ["id"])
    added = e.select((F.col("label") + 1_000_000).cast("long").alias("id"), (F.col("id") + 100).cast("int").alias("label"), F.lit(0.0).alias("head"))
    bucket_store.upsert(added, base, ["id"], ["label"])
    bucket_store.vacuum(spark, base, 1)
    return bucket_store.read(spark, base).select("id", "label", "head")


ASKED = f"SELECT q.vec_id AS query, v.vec_id AS id, list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0"


def questions(v):
    """Every twentieth vector as a query."""
    return v.where("id % 20 = 0")


def best(found):
    return found.select("query", "id", "place", F.round("distance", 6).alias("distance"))


@query(f"SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY d, id) AS place, round(d, 6) AS distance FROM ({ASKED}) QUALIFY place <= 5")
def vector_search_exact(spark, sf):
    """Many queries at once over the index with all cells probed."""
    v = vectors(spark, sf)
    index = vector_index.build(v, shared_path(spark, "index"))
    return best(vector_index.search(index, questions(v), 5, len(index.centres)))


@query(f"SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY d, id) AS place, round(d, 6) AS distance FROM ({ASKED} AND v.vec_id % 5 <> 0 AND v.label % 4 IN (0, 1)) QUALIFY place <= 3")
def vector_search_exact_filtered(spark, sf):
    """The same with a filter that holds before cells are probed."""
    v = vectors(spark, sf)
    index = vector_index.build(v, shared_path(spark, "index"))
    return best(vector_index.search(index, questions(v), 3, len(index.centres), P.vector_filter(hide_nsfw=True, mime_types=("text/plain", "application/pdf"))))


@query()
def vector_search_probed(spark, sf):
    """As many cells as the measured recall asks for; not all rows are seen, so SQL has no twin."""
    v = vectors(spark, sf)
    return best(vector_index.search(vector_index.build(v, shared_path(spark, "index")), questions(v), 5))
