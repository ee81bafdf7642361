"""Text analysis by a pluggable model: short texts in one call, long ones by chunks that are merged."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlight.functions import predicates as P
from archlight.functions import schema as S
from archlight.functions import tasks as K
from archlight.functions import text as X

from . import merging

SINGLE_BYTES = 3000
UNAVAILABLE = "Analysis unavailable"
#: A model takes a text and gives a summary and people; the default is by rules.
Model = Callable[[str], tuple[str, list[str]]]
#: A chat model takes the instructions, the text and the seconds it may take, and gives its reply.
Chat = Callable[[str, str, float], str]
ATTEMPTS, LEAST_SECONDS, FAILURES = 2, 60.0, 5
STRICT = "Answer with one JSON value and nothing else: no fences, no remarks."


def rules(df: DataFrame) -> DataFrame:
    """The default model, in column expressions: leading sentences, capitalised names."""
    return df.withColumns({"summary": X.summary(F.col("chunk_text")), "people": X.entities(F.col("chunk_text"))})


def by_model(df: DataFrame, model: Model) -> DataFrame:
    """Runs a Python model over chunks; a chunk that fails is left out."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, chunk, text in zip(part["key"], part["chunk"], part["chunk_text"]):
                try:
                    rows.append((key, chunk, *model(text)))
                except Exception:  # noqa: BLE001  one chunk must not end the run
                    continue
            yield pd.DataFrame(rows, columns=["key", "chunk", "summary", "people"])

    return df.select("key", "chunk", "chunk_text").mapInPandas(work, "key long, chunk int, summary string, people array<string>")


class Answers:
    """What a task asks a chat model: replies that are no JSON are asked for once more, strictly.

    After ``FAILURES`` texts in a row without an answer the model is asked no more in this task. Texts that were asked
    before are answered from memory, so several results of one text cost one call.
    """

    def __init__(self, chat: Chat, instructions: str, seconds: float = 0.0, remembered: int = 1024) -> None:
        self.chat, self.instructions, self.seconds, self.remembered = chat, instructions, max(seconds, LEAST_SECONDS), remembered
        self.failed, self.known = 0, {}

    def ask(self, text: str) -> tuple[str | None, str | None]:
        """The reply as it came and what went wrong, one of them null."""
        if text in self.known:
            return self.known[text]
        if self.failed >= FAILURES:
            return None, f"not asked: {FAILURES} failures in a row"
        out: tuple[str | None, str | None] = (None, None)
        for attempt in range(ATTEMPTS):
            try:
                reply = self.chat(f"{self.instructions}\n\n{STRICT}" if attempt else self.instructions, text, self.seconds)
            except TimeoutError as e:  # a slow model is not asked again
                out = None, f"timeout: {e}"
                break
            except Exception as e:  # noqa: BLE001  one text must not end the run
                out = None, f"{type(e).__name__}: {e}"
                break
            if has_json(reply):
                out = reply, None
                break
            out = None, "no JSON in the reply"
        self.failed = self.failed + 1 if out[0] is None else 0
        if len(self.known) >= self.remembered:
            self.known.pop(next(iter(self.known)))
        self.known[text] = out
        return out


def has_json(reply: str) -> bool:
    """Whether a reply is JSON or holds some from its first bracket on; the engine cuts it out afterwards."""
    try:
        json.loads(reply)
        return True
    except (TypeError, ValueError):
        first = re.search(r"[{\[]", reply or "")
    try:
        return first is not None and json.JSONDecoder().raw_decode(reply, first.start()) is not None
    except ValueError:
        return False


def by_chat(parts: DataFrame, load: Callable[[], Chat], instructions: str, seconds: float = 0.0) -> DataFrame:
    """``key, chunk, reply, error`` of the chunks in ``key, chunk, chunk_text``: the reply's JSON; each task loads the model once."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answers = Answers(load(), instructions, seconds)
        for part in batches:
            found = [answers.ask(t) for t in part["chunk_text"]]
            yield pd.DataFrame({"key": part["key"], "chunk": part["chunk"], "reply": [r for r, _ in found], "error": [e for _, e in found]})

    asked = parts.select("key", "chunk", "chunk_text").mapInPandas(work, "key long, chunk int, reply string, error string")
    read = asked.withColumn("json", X.parse_reply(F.col("reply")))
    return read.select("key", "chunk", F.col("json").alias("reply"), F.coalesce("error", F.when(F.col("json").isNull(), "no JSON in the reply")).alias("error"))


def analyze_text(m: DataFrame, size: int = 1024, max_chunks: int = 0, model: Model | None = None) -> DataFrame:
    """``key, summary, people`` for each file with text; files all of whose chunks fail get a notice."""
    parts = text_parts(m, F.lit(True), size, max_chunks)
    found = by_model(parts, model) if model else rules(parts)
    return with_all(m.where(P.has_text()), merging.merge_text(found, "key"), {"summary": F.lit(UNAVAILABLE), "people": F.array().cast("array<string>")})


def analyze_by_chat(m: DataFrame, load: Callable[[], Chat], instructions: str, size: int = 1024) -> DataFrame:
    """``key, summary, people, passwords, estate, errors``: one call for a chunk gives all that a file's tasks need."""
    kind = f"summary string, mentioned_people array<string>, passwords array<{S.PASSWORD}>, estate {S.ESTATE}"
    asked = by_chat(text_parts(m, F.lit(True), size), load, instructions)
    told = asked.withColumn("r", F.from_json("reply", kind))
    none = F.array().cast
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("chunk", c.alias("v"))), lambda a, b: a["chunk"] - b["chunk"]), lambda x: x["v"])  # noqa: E731  maps have no order
    merged = told.groupBy("key").agg(
        F.array_join(in_order(F.col("r.summary")), " ").alias("summary"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("r.mentioned_people", none("array<string>")))))).alias("people"),
        F.flatten(in_order(X.good_passwords(F.coalesce("r.passwords", none(f"array<{S.PASSWORD}>"))))).alias("passwords"),
        F.flatten(in_order(F.map_entries(X.good_estate(F.coalesce("r.estate", F.from_json(F.lit("{}"), S.ESTATE)))))).alias("estate"),
        F.count("error").alias("errors"),
        F.count(F.lit(1)).alias("chunks"),
    )
    failed = F.col("errors") == F.col("chunks")
    return merged.select("key", F.when(failed, UNAVAILABLE).otherwise(F.col("summary")).alias("summary"), "people", "passwords", "estate", "errors")


def complete_without_text(m: DataFrame) -> DataFrame:
    """Files without text have their text tasks complete: no passwords, nothing for an estate."""
    none = ~P.has_text()
    done = F.transform("analysis_tasks", lambda t: F.when(t["name"].isin(*K.TEXT_TASKS), F.struct(t["name"].alias("name"), F.lit(S.TASK_COMPLETE).alias("status"), F.lit(None).cast("string").alias("error_message"), t["version"].alias("version"))).otherwise(t))
    false = lambda c: F.when(none, False).otherwise(F.col(c)).alias(c)
    return m.withColumns({
        "analysis_tasks": F.when(none, done).otherwise(F.col("analysis_tasks")), "contains_password": false("contains_password"), "has_estate_relevant_info": false("has_estate_relevant_info"),
        "passwords": F.when(none, F.array().cast(f"array<{S.PASSWORD}>")).otherwise(F.col("passwords")), "estate_information": F.when(none, F.from_json(F.lit("{}"), S.ESTATE)).otherwise(F.col("estate_information")),
    })


UNREADABLE = "Image could not be read."


def describe_images(m: DataFrame, describe: Callable[[bytes], str] | None = None) -> DataFrame:
    """``key, description, summary`` of images in ``manifest_idx, content, summary``: a file that cannot be read gets a fixed message, a summary that is there stays."""

    def one(data: bytes | None) -> str:
        try:
            return describe(bytes(data)) if describe and data is not None else UNREADABLE
        except Exception:  # noqa: BLE001  one image must not end the run
            return UNREADABLE

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"key": part["manifest_idx"], "description": [one(c) for c in part["content"]], "own": part["summary"]})

    told = m.select("manifest_idx", "content", "summary").mapInPandas(work, "key long, description string, own string")
    return told.select("key", "description", F.coalesce(F.nullif("own", F.lit("")), F.col("description")).alias("summary"))


def classify_nsfw(scores: DataFrame, key: str) -> DataFrame:
    """``key, label, score, is_nsfw`` from ``key, label, score`` of an image classifier: the top class decides; none is safe at 0."""
    top = scores.groupBy(key).agg(F.max(F.struct(F.coalesce("score", F.lit(-1.0)).alias("score"), "label")).alias("t"))
    label = F.coalesce("t.label", F.lit("SFW"))
    return top.select(key, label.alias("label"), F.when(F.col("t.label").isNull(), 0.0).otherwise(F.col("t.score")).alias("score"), (F.lower(label) == "nsfw").alias("is_nsfw"))


#: Categories of an estate and words that speak of them, for the default rules.
ESTATE_WORDS = {"Legal": "will|trust|deed|attorney", "Financial": "account|bank|pension|stock", "Insurance": "insurance|policy", "Digital": "password|login|domain", "Medical": "hospital|doctor|prescription", "Personal": "letter|photo|diary"}
RED_FLAGS = "unreported|offshore|late filing|penalty|overdue|shell company"


def text_parts(m: DataFrame, gate: Column, size: int = 1024, max_chunks: int = 0) -> DataFrame:
    """Chunks of the texts that pass a cheap native gate; the costly step runs on these only."""
    text = F.col("extracted_text")
    every = F.when(F.octet_length(text) <= SINGLE_BYTES, F.array(text)).otherwise(X.chunks(text, size))
    pieces = F.slice(every, 1, max_chunks) if max_chunks else every
    return m.where(P.has_text() & gate).select(F.col("manifest_idx").alias("key"), F.posexplode(pieces).alias("chunk", "chunk_text"))


def with_all(m: DataFrame, found: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """A row for every file; those without text or behind the gate get the defaults."""
    return m.select(F.col("manifest_idx").alias("key")).join(found, "key", "left").select("key", *(F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()))


def analyze_passwords(m: DataFrame) -> DataFrame:
    """``key, passwords, contains_password``: matches of the secret rules as entries; a text without any, and no text, is false."""
    text = F.coalesce(F.col("extracted_text"), F.lit(""))
    entry = lambda k: lambda s: F.struct(F.lit(k).alias("context"), s.alias("password"))
    rules = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), entry(k)) for k, p in X.SECRET_RULES.items()]
    found = m.select(F.col("manifest_idx").alias("key"), X.good_passwords(F.concat(*rules)).alias("passwords"))
    return found.withColumn("contains_password", F.size("passwords") > 0)


def analyze_financial(m: DataFrame) -> DataFrame:
    """``key, red_flags, has_red_flags, confidence`` of files that speak of money; others have none."""
    parts = text_parts(m, P.financial())
    flags = F.array_distinct(F.regexp_extract_all(F.lower("chunk_text"), F.lit(f"({RED_FLAGS})"), F.lit(1)))
    rated = parts.withColumns({"red_flags": flags, "items": F.array().cast("array<string>")}).withColumn("confidence", F.least(F.size("red_flags") * 20, F.lit(100)))
    none = F.array().cast("array<string>")
    return with_all(m, merging.merge_financial(rated, "key").drop("items"), {"red_flags": none, "has_red_flags": F.lit(False), "confidence": F.lit(0)})


def analyze_estate(m: DataFrame) -> DataFrame:
    """``key, category, items``: lines of relevant texts by category, each once, with what makes them matter."""
    anything = F.rlike(F.lower("extracted_text"), F.lit(rf"\b({'|'.join(ESTATE_WORDS.values())})\b"))
    parts = text_parts(m, F.coalesce(anything, F.lit(False)))
    lines = lambda k, p: F.transform(F.filter(F.split("chunk_text", r"\n|(?<=[.!?])\s"), lambda s: F.rlike(F.lower(s), F.lit(rf"\b({p})\b"))), lambda s: F.struct(F.lit(k).alias("category"), F.trim(s).alias("item"), F.regexp_extract(F.lower(s), rf"\b({p})\b", 1).alias("why_it_matters")))
    return merging.merge_estate(parts.withColumn("entries", F.concat(*(lines(k, p) for k, p in ESTATE_WORDS.items()))), "key")


def analyze_access(m: DataFrame, tables: DataFrame) -> DataFrame:
    """``manifest_idx, extracted_text, summary``: the text of a file's tables behind its own, a summary from it if there is none; ``tables`` has ``manifest_idx, table_text``."""
    joined = m.join(tables, "manifest_idx", "left")
    text = X.append_unless_contained(F.col("extracted_text"), F.col("table_text"))
    return joined.select("manifest_idx", text.alias("extracted_text"), F.when(F.coalesce(F.col("summary"), F.lit("")) == "", X.summary(F.col("table_text"))).otherwise(F.col("summary")).alias("summary"))
