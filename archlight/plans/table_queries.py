"""Profiles, trends and text functions over the relational tables and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from archlight.functions import text as X
from archlight.operators import tabular
from archlight.sources.catalog_tables import table

from .registry import query

METRICS = ("o_orderkey", "o_custkey", "o_totalprice")
PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS metric, round(sum({c}), 2)::DOUBLE AS total, round(avg({c}), 4) AS mean, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, count(*) AS record_count FROM orders" for c in METRICS)
TREND = " UNION ALL ".join(f"SELECT strftime(o_orderdate, '%Y-%m') AS month, '{c}' AS metric, round(sum({c}), 2)::DOUBLE AS total FROM orders GROUP BY 1" for c in METRICS)


@query(PROFILE)
def numeric_profile(spark, sf):
    out = tabular.numeric_profile(table(spark, sf, "orders"))
    return out.select("metric", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "low", "high", "record_count")


@query(TREND)
def monthly_trend(spark, sf):
    return tabular.monthly_trend(table(spark, sf, "orders")).withColumn("total", F.round("total", 2))


@query("SELECT 'orders' AS name, 'o_orderdate' AS date_column UNION ALL SELECT 'events', 'ts' UNION ALL SELECT 'text dates', 'created' UNION ALL SELECT 'part', NULL")
def date_column_detection(spark, sf):
    text = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate").cast("date").cast("string")).otherwise("soon").alias("created"))
    found = [(n, tabular.date_column(t)) for n, t in (("orders", table(spark, sf, "orders")), ("events", table(spark, sf, "events")), ("text dates", text), ("part", table(spark, sf, "part")))]
    return spark.createDataFrame(found, "name string, date_column string")


CLEAN = "regexp_replace(lower(w), '[^a-zA-Z]', '', 'g')"
TOKENS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


@query(
    f"WITH t AS (SELECT doc_id, {TOKENS} AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM t), c AS (SELECT doc_id, {CLEAN} AS theme, count(*) AS n, min(pos) AS p FROM u GROUP BY 1, 2), "
    f"k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS r FROM c WHERE length(theme) > 3 AND theme NOT IN ({', '.join(map(repr, X.STOP_WORDS))})) SELECT doc_id, theme, n, CAST(r AS INT) AS theme_rank FROM k WHERE r <= 5"
)
def key_themes(spark, sf):
    return X.key_themes(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "theme", "n", "theme_rank")


@query(
    r"WITH e AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[A-Za-z0-9_]*[^\x00-\x7F][\pL\pN_]*', ' | ', 'g'), '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b', 1) AS f FROM documents), "
    "x AS (SELECT doc_id, unnest(f) AS s, generate_subscripts(f, 1) AS p FROM e), d AS (SELECT doc_id, s, min(p) AS p FROM x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM d), "
    "a AS (SELECT doc_id, string_agg(s, '|' ORDER BY p) AS entities FROM r WHERE r <= 10 GROUP BY doc_id) SELECT doc_id, coalesce(entities, '') AS entities FROM documents LEFT JOIN a USING (doc_id)"
)
def named_entities(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.entities(F.col("text")), "|").alias("entities"))


LEX = f"CASE WHEN {CLEAN} IN ({', '.join(map(repr, X.POSITIVE))}) THEN 1 WHEN {CLEAN} IN ({', '.join(map(repr, X.NEGATIVE))}) THEN -1 ELSE 0 END"


@query(
    f"WITH t AS (SELECT doc_id, {TOKENS} AS ws FROM documents), s AS (SELECT doc_id, coalesce(list_sum(list_transform(ws, lambda w: {LEX})), 0) / greatest(len(ws), 1) AS score FROM t) "
    "SELECT doc_id, round(score, 6) AS score, CASE WHEN score > 0.05 THEN 'positive' WHEN score < -0.05 THEN 'negative' ELSE 'neutral' END AS mood FROM s"
)
def sentiment(spark, sf):
    scored = table(spark, sf, "documents").select("doc_id", X.sentiment_score(F.col("text")).alias("score"))
    return scored.select("doc_id", F.round("score", 6).alias("score"), X.sentiment(F.col("score")).alias("mood"))


@query(
    r"WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), s AS (SELECT doc_id, t, array_to_string(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:2], ' ') AS f FROM t) "
    "SELECT doc_id, CASE WHEN t = '' THEN 'No textual content detected.' WHEN length(f) > 400 THEN rtrim(substring(f, 1, 397)) || '...' ELSE f END AS summary FROM s"
)
def summary_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.summary(F.col("text")).alias("summary"))


@query("SELECT n_regionkey, 'n_name: ' || string_agg(n_name, ' ' ORDER BY n_nationkey) || chr(10) || 'n_nationkey: ' || string_agg(n_nationkey::VARCHAR, ' ' ORDER BY n_nationkey) AS table_text FROM nation GROUP BY n_regionkey")
def table_text(spark, sf):
    return tabular.table_text(table(spark, sf, "nation"), ["n_name", "n_nationkey"], "n_nationkey", ["n_regionkey"])


@query("SELECT n_regionkey, '=== SHEET: nation ===' || chr(10) || 'Columns: n_name | n_regionkey' || chr(10) || string_agg(n_name || ' | ' || n_regionkey, chr(10) ORDER BY n_nationkey) AS sheet FROM nation GROUP BY n_regionkey")
def sheet_text(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return n.groupBy("n_regionkey").agg(tabular.sheet_text(n, "nation", "n_nationkey").alias("sheet"))


@query(
    r"WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda s: trim(regexp_replace(regexp_replace(s, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), lambda s: s <> '') AS f FROM pages) "
    "SELECT page_id, array_to_string(f, chr(10)) AS page_text FROM p"
)
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.markup_text(F.col("html"), "p").alias("page_text"))


@query("SELECT page_id, regexp_replace(url, '[^0-9A-Za-z_]+', '_', 'g') AS widget_key FROM pages")
def widget_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.widget_key(F.col("url")).alias("widget_key"))


LINES = "string_agg(n_name, ' ' ORDER BY n_nationkey)"


@query(
    "SELECT 'Table regions:' || chr(10) || (SELECT 'r_name: ' || string_agg(r_name, ' ' ORDER BY r_regionkey) FROM region) || chr(10) || chr(10) || 'Table nations:' || chr(10) || "
    f"(SELECT 'n_name: ' || {LINES} || chr(10) || 'n_regionkey: ' || string_agg(n_regionkey::VARCHAR, ' ' ORDER BY n_nationkey) FROM nation) AS combined"
)
def combined_tables(spark, sf):
    nations, regions = table(spark, sf, "nation"), table(spark, sf, "region")
    given = {"regions": (regions.select("r_regionkey", "r_name"), "r_regionkey"), "none": (nations.where("n_nationkey < 0").select("n_nationkey", "n_name"), "n_nationkey"), "nations": (nations.select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")}
    return tabular.joined_tables(tabular.combined_text(given))


@query(f"SELECT n_regionkey, {LINES} || ' ' || chr(10) || string_agg(lower(n_name), ' ' ORDER BY n_nationkey) AS flat_text FROM nation GROUP BY n_regionkey")
def flat_text_columns(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name", F.lower("n_name").alias("low"), F.nullif("n_name", F.lit("FRANCE")).alias("holed"))
    return tabular.flat_text(n.select("n_nationkey", "n_regionkey", "n_name", "low", F.when(F.col("n_nationkey") > 0, F.col("holed")).alias("holed")), "n_nationkey", ["n_regionkey"])


@query(f"SELECT doc_id, CAST(len({TOKENS}) AS INT) AS n_tokens FROM documents")
def count_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.words(F.col("text"))).alias("n_tokens"))


NATIONS = f"SELECT 1 AS i, 'nations' AS name, 'n_name: ' || {LINES} || chr(10) || 'n_regionkey: ' || string_agg(n_regionkey::VARCHAR, ' ' ORDER BY n_nationkey) || chr(10) || 'said: ' || string_agg('Growth of ' || n_name || ' is strong.', ' ' ORDER BY n_nationkey) AS t FROM nation"


@query(
    f"WITH x AS (SELECT 0 AS i, 'regions' AS name, 'r_name: ' || string_agg(r_name, ' ' ORDER BY r_regionkey) AS t FROM region UNION ALL {NATIONS}), "
    r"u AS (SELECT i, unnest(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> ''), 1) AS pos FROM x), "
    f"c AS (SELECT i, {CLEAN} AS theme, count(*) AS n, min(pos) AS p FROM u GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY n DESC, p) AS r FROM c WHERE length(theme) > 3 AND theme NOT IN ({', '.join(map(repr, X.STOP_WORDS))})), "
    f"s AS (SELECT i, sum({LEX}) / count(*) AS score FROM u GROUP BY i), f AS (SELECT i, array_to_string(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:2], ' ') AS f FROM x) "
    "SELECT x.i, name, CASE WHEN length(f) > 400 THEN rtrim(substring(f, 1, 397)) || '...' ELSE f END AS summary, (SELECT string_agg(theme, ',' ORDER BY r) FROM k WHERE k.i = x.i AND r <= 5) AS themes, round(score, 6)::DOUBLE AS score, CASE WHEN score > 0.05 THEN 'positive' ELSE 'neutral' END AS mood FROM x JOIN s USING (i) JOIN f USING (i)"
)
def database_analysis(spark, sf):
    """A database of two tables: summaries, themes and mood of what they say."""
    said = F.concat(F.lit("Growth of "), "n_name", F.lit(" is strong.")).alias("said")
    given = {"regions": (table(spark, sf, "region").select("r_regionkey", "r_name"), "r_regionkey"), "nations": (table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey", said), "n_nationkey")}
    return tabular.analyze_tables(given).select("i", "name", "summary", F.array_join("themes", ",").alias("themes"), F.round("score", 6).alias("score"), "mood")


def parts_sql(source: str, columns: dict[str, str], order: str, part: int, by: str = "") -> str:
    group = f"{by}, " if by else ""
    each = " UNION ALL ".join(f"SELECT {group}{i} AS i, '{c}' AS name, {order}, {shown} AS v FROM {source} WHERE {c} IS NOT NULL" for i, (c, shown) in enumerate(columns.items()))
    return (
        f"WITH x AS ({each}), n AS (SELECT *, row_number() OVER (PARTITION BY {group}i ORDER BY {order}, v) - 1 AS k FROM x), "
        f"p AS (SELECT {group}i, name, k // {part} AS part, count(*) AS n, string_agg(v, ' ' ORDER BY k) AS text FROM n GROUP BY ALL) "
        f"SELECT {group}i, name, part, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY {group}i ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", n, text FROM p"
    )


@query(parts_sql("lineitem", {"l_linestatus": "l_linestatus", "l_orderkey": "l_orderkey::VARCHAR", "l_returnflag": "l_returnflag"}, "l_orderkey, l_linenumber", 1000))
def table_text_parts(spark, sf):
    """The text of a large table's columns, in parts of so many values."""
    return tabular.text_parts(table(spark, sf, "lineitem"), ["l_linestatus", "l_orderkey", "l_returnflag"], ["l_orderkey", "l_linenumber"], part=1000)


@query(parts_sql("documents", {"text": "text", "lang": "lang"}, "doc_id", 100, "source"))
def flat_text_parts(spark, sf):
    """The text columns of a table by source, in parts; a column with a null is none."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text", "lang", F.when(F.col("doc_id") > 0, "x").alias("holed"))
    return tabular.flat_parts(docs, ["doc_id"], ["source"], 100)
