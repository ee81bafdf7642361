"""Task lifecycle, merging, chunking, JSON repair and pipeline metrics."""

from __future__ import annotations

import json
from datetime import datetime
from functools import reduce

from pyspark.sql import functions as F

from archlight.functions import predicates as P
from archlight.functions import tasks as K
from archlight.functions import text as X
from archlight.operators import analyze, merging, metrics
from archlight.operators.positions import numbered
from archlight.sources.catalog_tables import MANIFEST_SQL as M
from archlight.sources.catalog_tables import manifest, table
from archlight.sources.shared import shared_path
from archlight.streaming import rolling

from .registry import query

REQUIRED = """list_concat(CASE WHEN {has} THEN ['text_analysis', 'people_analysis', 'estate_analysis', 'password_detection', 'financial_analysis'] ELSE [] END,
  list_concat(CASE WHEN mime_type LIKE 'image/%' THEN ['image_description', 'nsfw_classification'] ELSE [] END, CASE WHEN mime_type LIKE 'video/%' THEN ['video_summary', 'nsfw_classification'] ELSE [] END))"""
HAS = REQUIRED.format(has="extracted_text IS NOT NULL")
NAMES = "list_transform(analysis_tasks, lambda t: t.name)"
MISSING = f"list_filter({HAS}, lambda x: NOT list_contains({NAMES}, x))"
STALE = "list_filter(analysis_tasks, lambda t: t.version < CASE WHEN t.name = 'password_detection' THEN 5 ELSE 1 END)"
OPEN = "list_filter(analysis_tasks, lambda t: t.status <> 'complete')"


@query(M + f"SELECT manifest_idx, array_to_string({HAS}, ',') AS tasks FROM m")
def task_selection(spark, sf):
    need = K.required(F.col("mime_type"), F.col("file_path"), F.col("extracted_text").isNotNull())
    return manifest(spark, sf).select("manifest_idx", F.array_join(need, ",").alias("tasks"))


@query(M + f"SELECT manifest_idx, array_to_string(list_concat({NAMES}, {MISSING}), ',') AS tasks FROM m")
def ensure_tasks(spark, sf):
    all_ = K.ensure(F.col("extracted_text").isNotNull())
    return manifest(spark, sf).select("manifest_idx", F.array_join(F.transform(all_, lambda t: t["name"]), ",").alias("tasks"))


@query(
    M + f"SELECT manifest_idx, CAST(len({MISSING}) + len({STALE}) AS INT) AS reset_count, CASE WHEN status IN ('complete', 'failed') AND len({MISSING}) + len({STALE}) > 0 THEN 'pending_analysis' ELSE status END AS status, "
    f"CASE WHEN list_contains({MISSING}, 'password_detection') OR len(list_filter({STALE}, lambda t: t.name = 'password_detection')) > 0 THEN NULL ELSE contains_password END AS contains_password FROM m"
)
def reset_outdated(spark, sf):
    return K.reset_outdated(manifest(spark, sf)).select("manifest_idx", "reset_count", "status", "contains_password")


@query(M + f"SELECT manifest_idx, array_to_string({HAS}, ',') AS tasks, 'pending_extraction' AS status, CAST(NULL AS VARCHAR) AS extracted_text FROM m")
def rescan_reset(spark, sf):
    return K.rescan(manifest(spark, sf)).select("manifest_idx", F.array_join(K.names(), ",").alias("tasks"), "status", "extracted_text")


BY_STATUS = "list_filter(analysis_tasks, lambda t: t.status = '{}')"
WAITING, BROKEN = BY_STATUS.format("pending"), BY_STATUS.format("error")


@query(
    M + f"SELECT manifest_idx, CASE WHEN len({OPEN}) > 0 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN len({WAITING}) > 0 THEN 'analysis_tasks_incomplete' WHEN len({BROKEN}) > 0 THEN 'analysis_task_failed' END AS reason, "
    f"CASE WHEN len({WAITING}) > 0 THEN array_to_string(list_transform({WAITING}, lambda t: t.name), ', ') WHEN len({BROKEN}) > 0 THEN array_to_string(list_transform({BROKEN}, lambda t: t.name || ': failed'), ', ') END AS info FROM m"
)
def file_status(spark, sf):
    return manifest(spark, sf).select("manifest_idx", K.file_status().alias("status"), K.file_reason().alias("r")).select("manifest_idx", "status", "r.reason", "r.info")


@query(M + f"SELECT manifest_idx, unnest({WAITING}).name AS task FROM m")
def pending_tasks(spark, sf):
    return manifest(spark, sf).select("manifest_idx", F.explode(P.pending_tasks("text")).alias("t")).select("manifest_idx", F.col("t.name").alias("task"))


@query(M + f"SELECT manifest_idx FROM m WHERE len(list_filter({WAITING}, lambda t: t.name = 'text_analysis')) > 0")
def pending_text_analysis(spark, sf):
    return manifest(spark, sf).where(F.size(P.pending_tasks(name="text_analysis")) > 0).select("manifest_idx")


@query(
    M + f"SELECT manifest_idx, array_to_string(list_transform(CASE WHEN regexp_matches(coalesce(extracted_text, ''), '\\S') THEN analysis_tasks ELSE list_transform(analysis_tasks, lambda t: struct_pack(name := t.name, status := 'complete', version := t.version)) END, lambda t: t.name || '=' || t.status), ',') AS tasks, "
    "CASE WHEN regexp_matches(coalesce(extracted_text, ''), '\\S') THEN contains_password ELSE false END AS contains_password, CAST(CASE WHEN regexp_matches(coalesce(extracted_text, ''), '\\S') AND has_password_rows THEN 1 ELSE 0 END AS INT) AS n_passwords FROM m"
)
def tasks_without_text(spark, sf):
    return analyze.complete_without_text(manifest(spark, sf)).select("manifest_idx", F.array_join(F.transform("analysis_tasks", lambda t: F.concat_ws("=", t["name"], t["status"])), ",").alias("tasks"), "contains_password", F.size("passwords").alias("n_passwords"))


@query(M + f"SELECT manifest_idx, unnest({OPEN}).name AS task, array_to_string(list_transform({OPEN}, lambda t: t.name), ', ') AS incomplete_tasks FROM m WHERE status IN ('complete', 'failed')")
def incomplete_audit(spark, sf):
    return K.incomplete(manifest(spark, sf)).select("manifest_idx", F.col("_task.name").alias("task"), "incomplete_tasks")


@query(M + ", c AS (SELECT manifest_idx, list_transform(analysis_tasks, lambda t: t.status) AS s FROM m) SELECT manifest_idx, " + ", ".join(f"CAST(len(list_filter(s, lambda x: x = '{k}')) AS INT) AS n_{k}" for k in ("complete", "error", "pending")) + " FROM c")
def task_rollup(spark, sf):
    return manifest(spark, sf).select("manifest_idx", *(K.count(k).alias(f"n_{k}") for k in ("complete", "error", "pending")))


# chunks

WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
CHUNKED = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
c AS (SELECT doc_id, unnest(range(0, len(ws), 256)) AS start_at, ws FROM w) """


@query(CHUNKED + "SELECT doc_id, CAST(start_at // 256 AS INT) AS chunk, CAST(ceil(len(ws) / 256.0) AS INT) AS n_chunks, array_to_string(ws[start_at + 1 : start_at + 256], ' ') AS chunk_text FROM c")
def chunk_text(spark, sf):
    cut = table(spark, sf, "documents").select("doc_id", X.chunks(F.col("text"), 256).alias("cut"))
    return cut.select("doc_id", F.size("cut").alias("n_chunks"), F.posexplode("cut").alias("chunk", "chunk_text"))


class WordTokens:
    """Words as tokens: what each task makes of a vocabulary that grows as it reads."""

    def __init__(self) -> None:
        self.ids, self.words = {}, []

    def encode(self, text):
        out = []
        for w in text.split():
            if w not in self.ids:
                self.ids[w] = len(self.words)
                self.words.append(w)
            out.append(self.ids[w])
        return out

    def decode(self, ids):
        return " ".join(self.words[i] for i in ids)


@query(CHUNKED + "SELECT doc_id, CAST(start_at // 256 AS INT) AS chunk, CAST(ceil(len(ws) / 256.0) AS INT) AS n_chunks, CAST(least(256, len(ws) - start_at) AS INT) AS n_tokens, array_to_string(ws[start_at + 1 : start_at + 256], ' ') AS chunk_text FROM c")
def token_chunks(spark, sf):
    """The same through the plug point for tokenizers."""
    return X.chunks_by(table(spark, sf, "documents"), "doc_id", "text", 256, WordTokens)


HALVED = "CASE WHEN floor((least(n, 1024) + 100) * 2.0) <= 1500 THEN 1024 WHEN floor((least(n, 512) + 100) * 2.0) <= 1500 THEN 512 ELSE 256 END"


@query(f"SELECT doc_id, CAST(size AS INT) AS chunk_size, CAST(ceil(n / size) AS INT) AS n_chunks FROM (SELECT doc_id, n, {HALVED} AS size FROM (SELECT doc_id, len({WORDS}) AS n FROM documents))")
def adaptive_chunks(spark, sf):
    sized = table(spark, sf, "documents").select("doc_id", "text", X.adaptive_size(F.size(X.words(F.col("text"))), 2048, 1500, 100).alias("chunk_size"))
    return sized.select("doc_id", "chunk_size", F.size(X.sized_chunks(F.col("text"), F.col("chunk_size"))).alias("n_chunks"))


@query(f"SELECT doc_id, CAST(ceil(len({WORDS}) / 341.0) AS INT) AS n_chunks FROM documents")
def embedding_chunks(spark, sf):
    size = X.adaptive_size(F.size(X.words(F.col("text"))), X.chunk_size(), 2048, margin=1.8)
    return table(spark, sf, "documents").select("doc_id", F.size(X.sized_chunks(F.col("text"), size)).alias("n_chunks"))


@query(CHUNKED + "SELECT doc_id, CAST(start_at // 256 AS INT) AS chunk, array_to_string(ws[start_at + 1 : start_at + 256], ' ') AS chunk_text FROM c WHERE start_at < 512")
def chunk_limit(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.slice(X.chunks(F.col("text"), 256), 1, 2)).alias("chunk", "chunk_text"))


@query(f"SELECT doc_id, CAST(CASE WHEN strlen(text) = 0 THEN 0 WHEN strlen(text) <= 3000 THEN 1 ELSE least(ceil(len({WORDS}) / 341.0), 10) END AS INT) AS n_chunks FROM documents")
def chunk_estimate(spark, sf):
    limit = X.effective_limit(X.chunk_size())
    return table(spark, sf, "documents").select("doc_id", X.chunk_estimate(F.col("text"), limit, 10).cast("int").alias("n_chunks"))


def chat_parts(spark, sf):
    """Turns of a conversation as the chunks of a document."""
    t = F.col("turn")
    people = F.array(F.concat(F.lit("p"), (t % 3).cast("string")), F.col("role"))
    entry = lambda category, item: F.struct(category.alias("category"), item.alias("item"), F.col("role").alias("details"))
    entries = F.array(entry(F.when(t % 2 == 0, "Legal").otherwise("Medical"), F.concat(F.lit("item "), (t % 3).cast("string"))), entry(F.lit("Legal"), F.lit("deed")))
    return table(spark, sf, "conversations").select(
        "conv_id", t.alias("chunk"), F.col("text").alias("summary"), people.alias("people"), people.alias("red_flags"), F.array("role").alias("items"), (t * 10 % 101).alias("confidence"), entries.alias("entries"),
        F.when(t % 2 == 1, F.array(F.struct(F.col("role").alias("context"), F.lit("x").alias("password")))).otherwise(F.array().cast("array<struct<context:string,password:string>>")).alias("passwords"),
    )


PEOPLE = "array_to_string(list_sort(list_distinct(list_concat(list(role), list('p' || (turn % 3))))), ',')"


@query(f"SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS summary, {PEOPLE} AS people FROM conversations GROUP BY conv_id")
def chunk_merge_text(spark, sf):
    return merging.merge_text(chat_parts(spark, sf), "conv_id").select("conv_id", "summary", F.array_join("people", ",").alias("people"))


@query(f"SELECT conv_id, {PEOPLE} AS red_flags, array_to_string(list_sort(list_distinct(list(role))), ',') AS items, CAST(floor(avg(turn * 10 % 101)) AS INT) AS confidence, true AS has_red_flags FROM conversations GROUP BY conv_id")
def chunk_merge_financial(spark, sf):
    out = merging.merge_financial(chat_parts(spark, sf), "conv_id")
    return out.select("conv_id", F.array_join("red_flags", ",").alias("red_flags"), F.array_join("items", ",").alias("items"), "confidence", "has_red_flags")


@query(
    "WITH e AS (SELECT conv_id, turn, 0 AS pos, CASE WHEN turn % 2 = 0 THEN 'Legal' ELSE 'Medical' END AS category, 'item ' || (turn % 3) AS item, role FROM conversations UNION ALL SELECT conv_id, turn, 1, 'Legal', 'deed', role FROM conversations), "
    "f AS (SELECT conv_id, category, CAST(json_object('item', item, 'details', role) AS VARCHAR) AS entry, min(turn * 2 + pos) AS place FROM e GROUP BY ALL) SELECT conv_id, category, string_agg(entry, '|' ORDER BY place) AS items FROM f GROUP BY conv_id, category"
)
def chunk_merge_estate(spark, sf):
    return merging.merge_estate(chat_parts(spark, sf), "conv_id")


@query("SELECT conv_id, coalesce(string_agg(CASE WHEN turn % 2 = 1 THEN role END, ',' ORDER BY turn), '') AS contexts, max(turn % 2) = 1 AS contains_password FROM conversations GROUP BY conv_id")
def chunk_merge_passwords(spark, sf):
    out = merging.merge_passwords(chat_parts(spark, sf), "conv_id")
    return out.select("conv_id", F.array_join(F.transform("passwords", lambda p: p["context"]), ",").alias("contexts"), "contains_password")


PARTS = M + rf""", t AS (SELECT manifest_idx AS key, extracted_text AS t, list_filter(regexp_split_to_array(extracted_text, '\s+'), lambda w: w <> '') AS ws FROM m WHERE regexp_matches(coalesce(extracted_text, ''), '\S')),
l AS (SELECT key, CASE WHEN strlen(t) <= 3000 THEN [t] ELSE list_transform(range(0, len(ws), 1024), lambda i: array_to_string(ws[i + 1 : i + 1024], ' ')) END AS cs FROM t),
parts AS (SELECT key, unnest(cs) AS c, generate_subscripts(cs, 1) AS chunk FROM l)"""


@query(
    PARTS + r""", s AS (SELECT key, chunk, regexp_replace(c, '^\s+|\s+$', '', 'g') AS t FROM parts), f AS (SELECT key, chunk, t, array_to_string(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:2], ' ') AS f FROM s),
    u AS (SELECT key, string_agg(CASE WHEN t = '' THEN 'No textual content detected.' WHEN length(f) > 400 THEN rtrim(substring(f, 1, 397)) || '...' ELSE f END, ' ' ORDER BY chunk) AS summary FROM f GROUP BY key),
    e AS (SELECT key, chunk, regexp_extract_all(regexp_replace(c, '[A-Za-z0-9_]*[^\x00-\x7F][\pL\pN_]*', ' | ', 'g'), '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b', 1) AS f FROM parts),
    x AS (SELECT key, chunk, s, row_number() OVER (PARTITION BY key, chunk ORDER BY min(p)) AS r FROM (SELECT key, chunk, unnest(f) AS s, generate_subscripts(f, 1) AS p FROM e) GROUP BY key, chunk, s),
    p AS (SELECT key, array_to_string(list_sort(list(DISTINCT s)), ',') AS people FROM x WHERE r <= 10 GROUP BY key) SELECT key, summary, coalesce(people, '') AS people FROM u LEFT JOIN p USING (key)"""
)
def analyze_text(spark, sf):
    return analyze.analyze_text(manifest(spark, sf)).select("key", "summary", F.array_join("people", ",").alias("people"))


def stand_in():
    """A model for the query below: its first reply to every third text is no JSON, its second is."""
    asked = set()

    def chat(instructions, text, seconds):
        strict = text in asked
        asked.add(text)
        reply = json.dumps({"summary": text[:40], "mentioned_people": [text[:1]], "passwords": [{"context": "line", "password": text[:3]}, {"context": " ", "password": "x"}]})
        return reply[:-1] if len(text) % 3 == 0 and not strict else f"Here you are: {reply} ."

    return chat


@query(PARTS + ", k AS (SELECT key, string_agg(substring(c, 1, 40), ' ' ORDER BY chunk) AS summary, array_to_string(list_sort(list(DISTINCT substring(c, 1, 1))), ',') AS people, count(*) FILTER (trim(substring(c, 1, 3)) <> '') AS n_passwords FROM parts GROUP BY key) SELECT key, summary, people, n_passwords, CAST(0 AS BIGINT) AS errors FROM k")
def chat_analysis(spark, sf):
    """All results of a text from one call, through the plug point for models with its second attempt."""
    found = analyze.analyze_by_chat(manifest(spark, sf), stand_in, "Tell what the text says.")
    return found.select("key", "summary", F.array_join("people", ",").alias("people"), F.size("passwords").cast("long").alias("n_passwords"), "errors")


def quoted(pattern):
    return "'" + pattern.replace("'", "''") + "'"


FOUND = reduce(lambda a, b: f"list_concat({a}, {b})", (f"list_transform(regexp_extract_all(coalesce(extracted_text, ''), {quoted(p)}), lambda s: '{k}=' || s)" for k, p in X.SECRET_RULES.items()))


@query(M + f"SELECT manifest_idx AS key, array_to_string({FOUND}, '|') AS passwords, len({FOUND}) > 0 AS contains_password FROM m")
def password_detection(spark, sf):
    found = analyze.analyze_passwords(manifest(spark, sf))
    return found.select("key", F.array_join(F.transform("passwords", lambda p: F.concat_ws("=", p["context"], p["password"])), "|").alias("passwords"), "contains_password")


GATE = "(contains(lower(t), 'financial') OR contains(lower(t), 'account'))"


@query(
    PARTS + f""", g AS (SELECT key FROM t WHERE {GATE}), r AS (SELECT key, list_distinct(regexp_extract_all(lower(c), '({analyze.RED_FLAGS})', 1)) AS f FROM parts JOIN g USING (key)),
    a AS (SELECT key, array_to_string(list_sort(list_distinct(flatten(list(f)))), ',') AS red_flags, max(len(f)) > 0 AS has_red_flags, CAST(floor(avg(least(len(f) * 20, 100))) AS INT) AS confidence FROM r GROUP BY key)
    SELECT manifest_idx AS key, coalesce(red_flags, '') AS red_flags, coalesce(has_red_flags, false) AS has_red_flags, coalesce(confidence, 0) AS confidence FROM m LEFT JOIN a ON a.key = m.manifest_idx"""
)
def financial_analysis(spark, sf):
    return analyze.analyze_financial(manifest(spark, sf)).select("key", F.array_join("red_flags", ",").alias("red_flags"), "has_red_flags", "confidence")


CATEGORIES = " UNION ALL ".join(f"SELECT key, chunk, pos, '{k}' AS category, trim(s) AS item, regexp_extract(lower(s), '\\b({p})\\b', 1) AS why FROM s WHERE regexp_matches(lower(s), '\\b({p})\\b')" for k, p in analyze.ESTATE_WORDS.items())


@query(
    PARTS + rf""", b AS (SELECT key, chunk, string_split(regexp_replace(c, '([.!?])\s|\n', '\1' || chr(1), 'g'), chr(1)) AS ls FROM parts), s AS (SELECT key, chunk, unnest(ls) AS s, generate_subscripts(ls, 1) AS pos FROM b),
    e AS ({CATEGORIES}), f AS (SELECT key, category, CAST(json_object('item', item, 'why_it_matters', why) AS VARCHAR) AS entry, min(chunk * 1000000 + pos) AS place FROM e GROUP BY ALL) SELECT key, category, string_agg(entry, '|' ORDER BY place) AS items FROM f GROUP BY key, category"""
)
def estate_analysis(spark, sf):
    return analyze.analyze_estate(manifest(spark, sf))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'nsfw' ELSE 'SFW' END AS label, CASE WHEN toxic IS NULL THEN 0.0 ELSE 0.75 END::DOUBLE AS score, coalesce(toxic = 1, false) AS is_nsfw FROM documents LEFT JOIN labels USING (doc_id)")
def nsfw_classification(spark, sf):
    """Labels stand for the classes of an image classifier; a document without a label for an image it cannot read."""
    labelled = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    classes = F.array(F.struct(F.lit("nsfw").alias("label"), F.when(F.col("toxic") == 1, 0.75).otherwise(0.25).alias("score")), F.struct(F.lit("SFW").alias("label"), F.when(F.col("toxic") == 1, 0.25).otherwise(0.75).alias("score")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("score")))
    return analyze.classify_nsfw(labelled.select("doc_id", F.explode(F.when(F.col("toxic").isNull(), none).otherwise(classes)).alias("c")).select("doc_id", "c.label", "c.score"), "doc_id")


@query(M + "SELECT manifest_idx AS key, d.text[1:30] AS description, coalesce(nullif(summary, ''), d.text[1:30]) AS summary FROM m JOIN documents d ON d.doc_id = manifest_idx WHERE mime_type LIKE 'image/%'")
def image_descriptions(spark, sf):
    """A describer that reads a file's bytes as text; a file's own summary stays."""
    images = manifest(spark, sf).where("mime_type like 'image/%'").select("manifest_idx", "summary").join(table(spark, sf, "documents").select(F.col("doc_id").alias("manifest_idx"), F.col("text").cast("binary").alias("content")), "manifest_idx")
    return analyze.describe_images(images, lambda data: data.decode()[:30])


@query("SELECT conv_id, CASE WHEN count(*) = 1 THEN max(text) ELSE string_agg(text, ' ' ORDER BY turn) FILTER (rn <= 3) END AS summary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id")
def video_summary(spark, sf):
    """Turns stand for the descriptions of frames; no model joins them."""
    frames = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("frames"))
    return frames.select("conv_id", X.video_summary(F.col("frames"), F.lit(True)).alias("summary"))


# JSON and normalisers

FENCED = {0: (" ```json\n", "\n``` "), 1: ("```\n", "```"), 2: (" \n", "\t"), 3: ("So: ```json\n", "\nbye")}


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'So: ```json' || chr(10) || props || chr(10) || 'bye' ELSE props END AS reply FROM events")
def json_clean(spark, sf):
    """Fences at the ends go, one inside stays."""
    k = F.col("event_id") % 4
    fenced = F.coalesce(*(F.when(k == i, F.concat(F.lit(a), "props", F.lit(b))) for i, (a, b) in FENCED.items()))
    return table(spark, sf, "events").select("event_id", X.strip_fences(fenced).alias("reply"))


#: What comes before and behind a reply's JSON; the last three hold none that closes.
SAID = {0: ("Here it is: ", " as asked }"), 1: ("```json\n", "\n```"), 2: ("List: [", ', "a ] \\" b"] end {'), 3: ("no value", None), 4: ('{"open": ', ""), 5: ("{ ] ", "")}


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN '[' || props || ', "a ] \\" b"]' END AS reply FROM events""")
def json_segment(spark, sf):
    """Replies with text around their JSON, in fences, with brackets in strings, without JSON, unclosed, and with a wrong closer."""
    k = F.col("event_id") % 6
    said = F.coalesce(*(F.when(k == i, F.lit(a) if b is None else F.concat(F.lit(a), "props", F.lit(b))) for i, (a, b) in SAID.items()))
    return table(spark, sf, "events").select("event_id", X.parse_reply(said).alias("reply"))


@query("SELECT conv_id, turn, role || '=' || split_part(text, ' ', 2) AS kept FROM conversations WHERE trim(split_part(text, ' ', 2)) <> '' AND role = 'user'")
def password_normalize(spark, sf):
    """The second word of a turn as a password; only a user's has a context."""
    context = F.when(F.col("role") == "user", F.col("role")).when(F.col("turn") % 2 == 0, " ")
    rows = F.array(F.struct(context.alias("context"), F.split_part("text", F.lit(" "), F.lit(2)).alias("password")))
    kept = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(X.good_passwords(rows)).alias("p"))
    return kept.select("conv_id", "turn", F.concat_ws("=", "p.context", "p.password").alias("kept"))


@query(
    "WITH w AS (SELECT doc_id, trim(split_part(text, ' ', 1)) AS item, trim(source) AS why, CASE WHEN lang = 'en' THEN 'Unknown' ELSE lang END AS details FROM documents), "
    "k AS (SELECT * FROM w WHERE item <> '' AND lower(item) NOT IN ('details', 'detail', 'unknown', 'n/a', 'na', 'none', 'placeholder')) "
    "SELECT d.doc_id, coalesce('Legal: ' || item || '/' || why || CASE WHEN details <> 'Unknown' THEN '/' || details ELSE '' END, '') AS kept FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id"
)
def estate_normalize(spark, sf):
    """A document's first word, source and language as an entry; English counts as unknown, and a second category has no item."""
    word, details = F.split_part("text", F.lit(" "), F.lit(1)), F.when(F.col("lang") == "en", "Unknown").otherwise(F.col("lang"))
    info = F.create_map(F.lit("Legal"), F.array(F.create_map(F.lit("item"), F.concat(F.lit(" "), word, F.lit(" ")), F.lit("why_it_matters"), F.col("source"), F.lit("details"), details)), F.lit("Digital"), F.array(F.create_map(F.lit("item"), F.lit("N/A"), F.lit("why_it_matters"), F.col("lang"))))
    shown = F.transform(F.map_entries(X.good_estate(info)), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(F.transform(e["value"], lambda m: F.concat_ws("/", m["item"], m["why_it_matters"], F.try_element_at(m, F.lit("details")))), ",")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(shown, ";").alias("kept"))


LINE_RULES = " UNION ALL ".join(f"SELECT doc_id, line, '{k}' AS kind, regexp_extract_all(s, {quoted(p)}) AS f FROM x" for k, p in X.SECRET_RULES.items())


@query(
    rf"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS line FROM l), r AS ({LINE_RULES}), "
    "u AS (SELECT doc_id, line, kind, unnest(f) AS secret, generate_subscripts(f, 1) AS p FROM r WHERE len(f) > 0), d AS (SELECT doc_id, line, kind, secret, min(p) AS p FROM u GROUP BY ALL) "
    "SELECT doc_id, kind || '_' || line || '_' || row_number() OVER (PARTITION BY doc_id, line, kind ORDER BY p) AS label, secret FROM d"
)
def secret_scan(spark, sf):
    """Every distinct match of a rule and line, numbered in order."""
    return X.secrets(table(spark, sf, "documents"), "doc_id", "text")


# metrics over events: a user is a file, an event a chunk


ROLLING = "SELECT event_id, round(avg(value) OVER w, 6) AS recent_avg, count(value) OVER w AS recent_n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(ROLLING)
def moving_chunk_average(spark, sf):
    out = metrics.moving_average(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value")
    return out.select("event_id", F.round("recent_avg", 6).alias("recent_avg"), "recent_n")


#: Slices of time that arrive one after another.
SLICES = 3


@query(ROLLING)
def moving_average_stream(spark, sf):
    """The same while events arrive: a stream with keyed state, ended after each slice of time and started again from its checkpoint."""
    base = shared_path(spark, "rolling")
    events = numbered(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), ["ts", "event_id"], name="at")
    n = events.count()
    for k in range(SLICES):
        events.where((F.col("at") * SLICES >= n * k) & (F.col("at") * SLICES < n * (k + 1))).drop("at").write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(events.drop("at").schema).parquet(f"{base}/in")
        rolling.write(rolling.moving_average(arriving, "user_id", ["ts", "event_id"], "value"), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("event_id", F.round("recent_avg", 6).alias("recent_avg"), "recent_n")


@query(
    "WITH p AS (SELECT event_id, list_sort(coalesce(list(value) FILTER (value > 0) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])) AS v FROM events) "
    "SELECT event_id, round(CASE WHEN len(v) < 4 THEN 60.0 ELSE greatest(60.0, 5 * v[least(greatest(ceil(0.75 * (len(v) + 1)), 1), len(v))::INT]) END, 6)::DOUBLE AS timeout FROM p"
)
def dynamic_timeout(spark, sf):
    out = metrics.dynamic_timeout(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value")
    return out.select("event_id", F.round("timeout", 6).alias("timeout"))


@query(
    "WITH c AS (SELECT user_id, event_id, value, event_id % 5 + 1 AS chunks, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events), "
    "a AS (SELECT user_id, sum(chunks) AS total_chunks, count(*) AS file_samples, sum(value) / sum(chunks) AS s, avg(chunks) AS f, avg(value / chunks) FILTER (rn <= 20) AS r, list_sort(coalesce(list(value / chunks) FILTER (rn <= 20 AND value / chunks > 0), [])) AS v FROM c GROUP BY user_id) "
    "SELECT user_id, CAST(total_chunks AS BIGINT) AS total_chunks, file_samples, round(s, 6) AS avg_chunk_seconds, round(f, 6) AS avg_chunks_per_file, round(r, 6) AS recent_avg_seconds, round(CASE WHEN len(v) > 0 THEN v[least(greatest(ceil(0.75 * (len(v) + 1)), 1), len(v))::INT] END, 6) AS p75, round(f * 7, 6) AS remaining_chunks, round(f * 7 * s, 6) AS remaining_seconds FROM a"
)
def metrics_snapshot(spark, sf):
    events = table(spark, sf, "events").withColumn("chunks", F.col("event_id") % 5 + 1)
    out = metrics.snapshot(events, "user_id", "event_id", "chunks", "value", 7)
    doubles = ("avg_chunk_seconds", "avg_chunks_per_file", "recent_avg_seconds", "p75", "remaining_chunks", "remaining_seconds")
    return out.select("user_id", "total_chunks", "file_samples", *(F.round(c, 6).alias(c) for c in doubles))


def snapshots(spark, sf):
    """Events of a user as snapshots of an archive, one every few hours."""
    return table(spark, sf, "events").select(F.col("user_id").alias("archive"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("name"), F.timestamp_seconds(F.lit(1_749_600_000) - F.col("event_id") * 500).alias("modified"))


@query("SELECT user_id AS archive, 's' || event_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 20 AS kept FROM events")
def retention_newest(spark, sf):
    return metrics.retain_newest(snapshots(spark, sf)).select("archive", "name", "kept")


@query("SELECT archive, name FROM (SELECT user_id AS archive, 's' || event_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n > 20")
def backups_to_delete(spark, sf):
    return metrics.retain_newest(snapshots(spark, sf)).where("not kept").select("archive", "name")


def tier_sql(level: int, slot: str, before: str) -> str:
    """A tier's keepers beside the ones before it: the newest of each slot that those leave free."""
    return f"k{level} AS (SELECT r.*, k OR (tier = {level} AND rn = min(rn) FILTER (tier = {level}) OVER w AND NOT max(k::INT) OVER w = 1) AS keep FROM (SELECT * EXCLUDE keep, keep AS k FROM {before}) r WINDOW w AS (PARTITION BY archive, {slot}))"


@query(
    "WITH s AS (SELECT user_id AS archive, 's' || event_id AS name, make_timestamp((1749600000 - event_id * 500) * 1000000) AS modified FROM events), "
    "a AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY modified DESC, name) AS rn, count(*) OVER (PARTITION BY archive) AS many, epoch(TIMESTAMP '2025-06-11 12:00:00') - epoch(modified) AS age, strftime(modified, '%Y-%m-%d') AS d, strftime(modified, '%Y-%W') AS w, strftime(modified, '%Y-%m') AS mo FROM s), "
    "k0 AS (SELECT *, CASE WHEN rn <= 3 THEN 0 WHEN age <= 604800 THEN 1 WHEN age <= 2592000 THEN 2 ELSE 3 END AS tier, rn <= 3 AS keep FROM a), " + ", ".join(tier_sql(i, slot, f"b{i - 1}" if i > 1 else "k0") + f", b{i} AS (SELECT * EXCLUDE k FROM k{i})" for i, slot in ((1, "d"), (2, "w"), (3, "mo")))
    + ", t AS (SELECT *, NOT keep AND age > 2592000 AND tier > 0 AS spare, 4 - sum((keep AND age > 2592000)::INT) OVER (PARTITION BY archive) AS short FROM b3), "
    "u AS (SELECT *, keep OR (spare AND row_number() OVER (PARTITION BY archive ORDER BY NOT spare, rn DESC) <= short) AS kept_ FROM t) SELECT archive, name, many <= 15 OR (kept_ AND sum(kept_::INT) OVER (PARTITION BY archive ORDER BY rn) <= 15) AS kept FROM u"
)
def retention_tiered(spark, sf):
    return metrics.retain_tiered(snapshots(spark, sf), datetime(2025, 6, 11, 12)).select("archive", "name", "kept")
