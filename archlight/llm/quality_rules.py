"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: punctuation (symbols, bars among them, and repeated marks), navigation (short lines
that end in no stop) and boilerplate (fixed phrases). Failing lines go; a document that loses more than ``max_lost`` of its word
characters is rejected. Base counts over the whole text come first and reject by themselves.

Words are runs of characters other than the six ASCII white-space ones. A null text has no words: all counts are 0, it
fails the base rules and its cleaned text is null. An empty text fails as well. A text may be of any length: it is judged
whole, within its row. A count that is exactly at a bound passes. Rows are judged one by one, so repeated rows give
repeated results; ids may be null. An empty table gives an empty result. Columns of other names pass through
``clean_documents`` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, unboxed

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
NO_SYMBOL = r"[^#*$%&|<>]+"
#: Phrases of boilerplate lines.
BOILERPLATE = "all rights reserved|privacy policy|cookie policy|terms of (use|service)|licensed under|released under the|javascript|click here|sign (in|up)|log in|subscribe"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line fails the punctuation rule with more symbols, or more repeated marks, than this share of its fields.
MAX_MARKS_PERCENT = 20
#: Boilerplate phrases count in lines of up to so many characters; a longer line is a paragraph.
NOTICE_CHARS = 200
#: A line with fewer fields, as spaces part them, fails the navigation rule unless it ends in a stop.
SHORT_LINE = 3
MAX_LOST_PERCENT = 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and gives it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, NO_SYMBOL, ""))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more: the windows' hashes are sorted with their positions, neighbours compared."""

    def windows(h: Column) -> Column:
        return F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i")),
        )

    def again(s: Column) -> Column:
        return F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, F.greatest(i - 1, F.lit(0)))["h"]) & (i > 0))

    def covered(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(x - s["last"], F.lit(3))).alias("n")),
            lambda s: s["n"],
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(F.sort_array(windows(h)), lambda s: covered(F.sort_array(F.transform(again(s), lambda x: x["i"])))))


def line_fails(line: Column) -> Column:
    fields = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    runs = F.when(F.contains(line, F.lit("!!")) | F.contains(line, F.lit("??")), F.regexp_count(line, F.lit(r"[!?]{2,}"))).otherwise(0)
    marks = symbols(line) + runs
    return (
        (marks * 100 > fields * MAX_MARKS_PERCENT) & (marks > 1)
        | (fields < SHORT_LINE) & ~F.rlike(line, F.lit(r"[.!?:;\"')\]…。]\s*$"))
        | (F.length(line) <= NOTICE_CHARS) & F.rlike(F.lower(line), F.lit(BOILERPLATE))
    )


def judge(docs: DataFrame) -> DataFrame:
    """``row``, all columns of ``docs``, and ``rules``: the counts, the verdicts and the cleaned text."""
    text = F.col("row")["text"]
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    good = F.filter(F.split(t, "\n"), lambda x: ~F.rlike(x, F.lit(WORD)) | ~line_fails(x))
    counted = boxed(docs).select(
        "row",
        F.struct(
            let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
            word_chars(t).cast("long").alias("word_chars"),
            symbols(t).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.array_join(good, "\n").alias("cleaned"),
        ).alias("r"),
        F.spark_partition_id().alias("once"),
    ).where("once >= 0")  # no filter is pushed below this column, so the struct is computed once
    r = F.col("r")
    base = (r["w"]["n_words"] < MIN_WORDS) | (r["w"]["n_repeat_words"] * 100 > r["w"]["n_words"] * MAX_REPEAT_PERCENT)
    lost = (r["word_chars"] - word_chars(r["cleaned"])).cast("long")
    rules = F.struct(
        r["w"]["n_words"].alias("n_words"),
        r["word_chars"].alias("word_chars"),
        r["n_symbols"].alias("n_symbols"),
        r["n_dup_lines"].alias("n_dup_lines"),
        r["w"]["n_repeat_words"].alias("n_repeat_words"),
        base.alias("base_failed"),
        lost.alias("lost_chars"),
        (~base & (lost * 100 <= r["word_chars"] * MAX_LOST_PERCENT)).alias("kept"),
        F.when(text.isNotNull(), r["cleaned"]).alias("cleaned"),
    )
    return counted.select("row", rules.alias("rules"))


def measure(docs: DataFrame) -> DataFrame:
    """One row of counts and verdicts per document, without its text."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept")
    return judge(docs.select("doc_id", "text")).select(F.col("row")["doc_id"].alias("doc_id"), *(F.col("rules")[n].alias(n) for n in names))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with failing lines removed from ``text`` and ``n_chars`` counted anew."""
    return unboxed(judge(docs).where(F.col("rules")["kept"]), docs.columns, F.col("rules")["cleaned"])


_W = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents
), counts AS (
  SELECT doc_id, t, len(w) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS lines,
    list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g,
    string_split(t, chr(10)) AS all_lines
  FROM base
), windows AS (
  SELECT doc_id, unnest(g) AS gram, generate_subscripts(g, 1) AS pos FROM counts
), again AS (
  SELECT doc_id, pos, pos - lag(pos, 1, -2) OVER (PARTITION BY doc_id ORDER BY pos) AS step
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT doc_id, sum(least(step, 3)) AS n FROM again GROUP BY doc_id
), judged AS (
  SELECT doc_id, list_filter(lines, lambda x:
    NOT ((100 * (length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) + len(regexp_extract_all(x, '[!?]{{2,}}'))) > 20 * (length(x) - length(replace(x, ' ', '')) + 1)
          AND length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) + len(regexp_extract_all(x, '[!?]{{2,}}')) > 1)
      OR (length(x) - length(replace(x, ' ', '')) + 1 < 3 AND NOT regexp_matches(x, '[.!?:;"'')\]…。]\s*$'))
      OR (length(x) <= 200 AND regexp_matches(lower(x), '{BOILERPLATE}')))) AS good FROM counts
), verdict AS (
  SELECT c.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed,
    word_chars - length(regexp_replace(array_to_string(good, chr(10)), '[\x20\x09-\x0D]+', '', 'g')) AS lost_chars
  FROM counts c JOIN judged j USING (doc_id) LEFT JOIN repeats r USING (doc_id)
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, CAST(lost_chars AS BIGINT) AS lost_chars, NOT base_failed AND 100 * lost_chars <= 30 * word_chars AS kept
FROM verdict
"""
