"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model gives each document its own evidence. It is fitted on a sample of at most ``SAMPLE`` labelled rows
(of the smallest hashes of their ids); everything else covers all documents. The evidence is averaged per path and per host
by grouped aggregation. A host's posterior shrinks toward the global mean, a path's toward its host, each by a prior
strength that the spread of the groups gives (method of moments): sparse groups stay near their prior. A document's
final odds are its own evidence times the odds of its path, relative to the global odds; its own share in its path and
its host is left out, so no evidence counts twice. ``documents`` has no URL: by default ``source`` stands for the host
and ``lang`` for the path.

Null text counts as empty; a document without words is rejected and is no evidence for its site. A null host or path is a
group of its own. A null id keeps its row. Rows keep their multiplicity: each of several equal rows is evidence for the
others, and all get the same verdict. A probability of exactly the threshold is kept. A text may be of any length. Without labelled rows of both kinds the evidence is neutral and every
document with words is kept. An empty table gives an empty result. Extra columns pass through ``keep`` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, settle, unboxed
from .quality_rules import WORD, let, symbols

#: Labelled rows to fit on, at most.
SAMPLE = 10_000
#: Documents with a smaller final probability are rejected.
THRESHOLD = 0.5
#: Bounds of a prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 10_000.0
NAMES = ("x_symbols", "x_marks", "x_capitals", "x_distinct", "x_again", "x_length", "x_stops")


def features(text: Column) -> Column:
    """A struct of what the classifier looks at; ``n_words`` is 0 for a text without words."""
    t = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.log1p(symbols(t) * 100 / n).alias("x_symbols"),
            F.log1p(F.when(F.contains(t, F.lit("!!")) | F.contains(t, F.lit("??")), F.regexp_count(t, F.lit(r"[!?]{2,}"))).otherwise(0) * 100 / n).alias("x_marks"),
            (F.length(F.regexp_replace(t, "[^A-Z]+", "")) / F.greatest(F.length(t), F.lit(1))).alias("x_capitals"),
            (F.size(F.array_distinct(w)) / n).alias("x_distinct"),
            (F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, F.greatest(i - 1, F.lit(0)))))) / n).alias("x_again"),
            F.log(n).alias("x_length"),
            (F.length(F.regexp_replace(t, "[^.]+", "")) / n).alias("x_stops"),
        )

    return let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), of_words)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    base: float  # intercept
    prior: float  # share of good documents in the sample

    def logit(self, x: Column) -> Column:
        total = F.lit(self.base)
        for name, w in zip(NAMES, self.weights):
            total = total + x[name] * F.lit(w)
        return total


def fit(rows: np.ndarray, good: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Model:
    """Logistic regression by Newton's method on standardised features."""
    share = float(good.mean()) if len(good) else 0.5
    if share in (0.0, 1.0) or not len(good):
        return Model((0.0,) * len(NAMES), 0.0, 0.5)
    mean, spread = rows.mean(0), rows.std(0) + 1e-9
    x = np.hstack(((rows - mean) / spread, np.ones((len(rows), 1))))
    w, hold = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (good - p) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    scaled = w[:-1] / spread
    return Model(tuple(map(float, scaled)), float(w[-1] - (scaled * mean).sum()), share)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the bounded sample; ``docs`` are the documents that the labels speak of."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    # hashes under a share of their range, a little more than the sample needs, so that tasks send no more than that
    place, full = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), 1 << 30
    share = min(full, int(full * 1.2 * sample / max(1, known.count())) + full // 1000)
    drawn = [(r[0], r[1]) for r in known.where(place <= share).orderBy(place, "doc_id", "quality").limit(sample).collect()]
    chosen = F.broadcast(spark.createDataFrame(drawn, "doc_id long, quality int"))  # sample rows at most
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("doc_id", "quality", features(F.col("text")).alias("x"))
    got = x.select("doc_id", "quality", *(F.col("x")[n].alias(n) for n in NAMES)).toPandas().sort_values(["doc_id", *NAMES])
    return fit(got[list(NAMES)].to_numpy(float), (got["quality"] > 0).to_numpy(float))


def evidence(docs: DataFrame, model: Model, host: str = "source", path: str = "lang") -> DataFrame:
    """``row``, all columns of ``docs``, and ``_host, _path, _words, _p``: the groups' keys and the document's own probability."""
    row = F.col("row")

    def key(c: str) -> Column:
        value = row[c].cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), value))

    # no filter is pushed below the column once, so features are computed once
    own = boxed(docs).select("row", key(host).alias("_host"), key(path).alias("_path"), features(row["text"]).alias("x"), F.spark_partition_id().alias("once")).where("once >= 0")
    logit = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), model.logit(F.col("x"))))
    return own.select("row", "_host", "_path", F.col("x")["n_words"].alias("_words"), (1 / (1 + F.exp(-logit))).alias("_p"))


def strength(spread: float, mean: float) -> float:
    """Documents that a beta prior is worth whose groups have this mean and variance."""
    return float(np.clip(mean * (1 - mean) / spread - 1, WEAKEST, STRONGEST)) if spread > 0 else STRONGEST


def sites(own: DataFrame) -> tuple[DataFrame, float, float, float]:
    """``_host, _path, _n, _s, _host_n, _host_s``: documents and sums of probabilities per path and of its host; the global mean and the prior strengths of hosts and paths.

    Documents without words are no evidence.
    """
    paths = own.groupBy("_host", "_path").agg(F.count_if(F.col("_words") > 0).alias("_n"), F.sum(F.when(F.col("_words") > 0, F.col("_p")).otherwise(0.0)).alias("_s"))
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_host_n"), F.sum("_s").alias("_host_s"))
    both = settle(paths.join(hosts, "_host"), "sites")  # its size is then known: Spark broadcasts it only where it is small
    row = both.where("_n > 0").agg(
        F.sum("_n").alias("n"),
        F.sum("_s").alias("s"),
        F.sum(F.col("_n") * F.pow(F.col("_s") / F.col("_n") - F.col("_host_s") / F.col("_host_n"), 2)).alias("within"),
        F.sum(F.col("_n") * F.pow(F.col("_host_s") / F.col("_host_n"), 2)).alias("hosts"),
    ).first()
    n = row["n"] or 0
    mean = min(max(row["s"] / n, 1e-6), 1 - 1e-6) if n else 0.5
    return both, mean, strength(row["hosts"] / n - mean * mean if n else 0.0, mean), strength(row["within"] / n if n else 0.0, mean)


def score(own: DataFrame, found: tuple[DataFrame, float, float, float]) -> DataFrame:
    """Adds ``_host_p, _path_p, _final, _kept`` to documents with their evidence."""
    table, mean, of_host, of_path = found
    joined = own.join(table, ["_host", "_path"], "left")
    p = F.when(F.col("_words") > 0, F.col("_p")).otherwise(0.0)
    one = F.when(F.col("_words") > 0, 1).otherwise(0)
    host = (F.coalesce("_host_s", F.lit(0.0)) - p + of_host * mean) / (F.coalesce("_host_n", F.lit(0)) - one + of_host)
    with_host = joined.withColumn("_host_p", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), host)))
    path = (F.coalesce("_s", F.lit(0.0)) - p + of_path * F.col("_host_p")) / (F.coalesce("_n", F.lit(0)) - one + of_path)
    with_path = with_host.withColumn("_path_p", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path)))
    odds = F.log(F.col("_p") / (1 - F.col("_p"))) + F.log(F.col("_path_p") / (1 - F.col("_path_p"))) - float(np.log(mean / (1 - mean)))
    final = with_path.withColumn("_final", 1 / (1 + F.exp(-odds)))
    return final.withColumn("_kept", (F.col("_words") > 0) & (F.col("_final") >= THRESHOLD))


def report(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``doc_id, n_words, p_document, host_posterior, path_posterior, p_quality, kept`` for every document."""
    model = train(docs, labels)
    own = settle(evidence(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", host, path), model, host, path).select(F.col("row")["doc_id"].alias("doc_id"), "_host", "_path", "_words", "_p"), "evidence")
    done = score(own, sites(own))
    names = {"_words": "n_words", "_p": "p_document", "_host_p": "host_posterior", "_path_p": "path_posterior", "_final": "p_quality", "_kept": "kept"}
    return done.select("doc_id", *(F.col(k).alias(v) for k, v in names.items()))


def keep(docs: DataFrame, model: Model, host: str = "source", path: str = "lang") -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    groups = sites(evidence(docs.select("text", host, path), model, host, path).select("_host", "_path", "_words", "_p"))
    return unboxed(score(evidence(docs, model, host, path), groups).where("_kept"), docs.columns)
