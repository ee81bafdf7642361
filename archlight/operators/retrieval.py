"""Vector search and prompt assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSION = 768
CHAT_K, CLI_K = 3, 5
CONTEXT_CHARS, SNIPPET_CHARS, HISTORY_TURNS, HISTORY_CHARS = 2000, 400, 3, 200


def squared_distance(vector: Column, query: list[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)


def top_k(vectors: DataFrame, query: list[float], k: int = CHAT_K, condition: Column | None = None, key: str = "id") -> DataFrame:
    """The nearest rows by squared distance, ties by key; each task keeps its own k rows, no sort of the table."""
    found = vectors if condition is None else vectors.where(condition)
    scored = found.withColumn("distance", squared_distance(F.col("embedding"), query))
    return scored.orderBy("distance", key).limit(k).withColumn("relevance", 1 - F.col("distance"))


def mean_pool(parts: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """The mean of the vectors of each key, by position, with partial sums before the shuffle."""
    spread = parts.select(key, F.posexplode(vector).alias("pos", "x"))
    means = spread.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vector))


def hashed_embedding(text: Column, dimension: int = 64) -> Column:
    """A deterministic bag-of-words vector: the default where no model is given; a zero vector for no text."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    slots = F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)).cast("int"))
    counts = lambda s: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double"))
    return F.get(F.transform(F.array(slots), counts), F.lit(0))


#: A model that embeds a text, or raises if the text is too long for it.
Embedder = Callable[[str], list[float]]


def embed_chunks(text: str, embed: Embedder, size: int, dimension: int = DIMENSION, floor: int = 128) -> list[float]:
    """The mean over chunks of so many tokens; the size is halved while a chunk fails, and zeros stand where the smallest does."""
    words = (text or "").split()
    if not words:
        return [0.0] * dimension
    while True:
        try:
            found = [embed(" ".join(words[i : i + size])) for i in range(0, len(words), size)]
            return [sum(x) / len(found) for x in zip(*found)]
        except Exception:  # noqa: BLE001  any failure of the model asks for shorter chunks
            if size <= floor:
                return [0.0] * dimension
            size = max(size // 2, floor)


def embed_texts(df: DataFrame, key: str, text: str, load: Callable[[], Embedder], size: int, dimension: int = DIMENSION) -> DataFrame:
    """``key, embedding`` by a model that each task loads once."""
    kind = dict(df.dtypes)[key]

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = load()
        for part in parts:
            yield pd.DataFrame({key: part[key], "embedding": [embed_chunks(t, embed, size, dimension) for t in part[text]]})

    return df.select(key, text).mapInPandas(work, f"{key} {kind}, embedding array<double>")


def document_text() -> Column:
    """What is embedded for a file: its non-empty texts in one line."""
    estate = F.when(F.size(F.map_keys("estate_information")) > 0, F.to_json("estate_information"))
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("file_name", "summary", "description", "extracted_text")]
    people = F.nullif(F.array_join("mentioned_people", ", "), F.lit(""))
    return F.trim(F.concat_ws(" ", *parts, people, estate))


def metadata() -> Column:
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return F.struct(text("file_path"), text("file_name"), text("mime_type"), F.split_part(F.coalesce("mime_type", F.lit("")), F.lit("/"), F.lit(1)).alias("file_type"), flag("is_nsfw"), flag("has_financial_red_flags"), flag("has_estate_relevant_info"))


def vector_rows(m: DataFrame, dimension: int = 64) -> DataFrame:
    return m.select(F.col("file_path").alias("id"), hashed_embedding(document_text(), dimension).alias("embedding"), metadata().alias("metadata"), document_text().alias("document"))


def upsert(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those with their id."""
    return vectors.join(new.select("id"), "id", "left_anti").unionByName(new)


def snippet(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def history(chat: DataFrame) -> DataFrame:
    """For each turn the last turns before it, shortened, one to a line."""
    line = F.concat(F.col("role"), F.lit(": "), snippet(F.col("text"), HISTORY_CHARS))
    past = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-HISTORY_TURNS, -1)
    return chat.withColumn("history", F.array_join(F.collect_list(line).over(past), "\n"))


def pack_context(entries: DataFrame, group: str, order: str, text: str, budget: int = CONTEXT_CHARS) -> DataFrame:
    """Entries that say something, with ``place`` and ``running_chars``, while their running length fits; the first always does.

    An entry has a character at least, so no group needs more than its first ``budget`` + 1; Spark keeps those per task
    before the shuffle, whatever a group's size.
    """
    by = Window.partitionBy(group).orderBy(order)
    first = entries.where(F.length(text) > 0).withColumn("place", F.row_number().over(by)).where(F.col("place") <= budget + 1)
    running = F.sum(F.length(text)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("running_chars", running).where((F.col("place") == 1) | (F.col("running_chars") <= budget))


def prompt(question: Column, context: Column, past: Column) -> Column:
    before = F.when(F.coalesce(past, F.lit("")) != "", F.concat(F.lit("Earlier turns:\n"), past, F.lit("\n\n"))).otherwise("")
    return F.concat(before, F.lit("Context:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), question)


def stats_answer(counts: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """The answer to a question about the collection: types in order with their counts, then flags, if given as ``name, n``."""
    shown = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, "n"))), lambda x: F.concat(x[name], F.lit(": "), x["n"].cast("string"))), "\n")
    out = counts.agg(F.concat(F.lit("Total files: "), F.sum("n").cast("string"), F.lit("\n"), shown("mime_type")).alias("answer"))
    if flags is None:
        return out
    marked = flags.where("n > 0").agg(shown("name").alias("marked"))  # a row of a few flags
    return out.join(F.broadcast(marked)).select(F.concat_ws("\n", "answer", F.nullif("marked", F.lit(""))).alias("answer"))


def any_frame_nsfw(frames: Column, prior: Column) -> Column:
    """True if any frame is; otherwise what was known before."""
    return F.when(F.exists(frames, lambda f: F.lower(f) == "nsfw"), True).otherwise(prior)


def selected_frames(n: Column, fps: Column, every: int = 10) -> Column:
    """Indexes of the frames taken from a video."""
    step = F.greatest(F.floor(fps * every).cast("int"), F.lit(1))
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, step)).otherwise(F.array().cast("array<int>"))
