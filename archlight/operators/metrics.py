"""Progress and timing of runs, and retention of snapshots."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import running_rank

RECENT = 20
TIMEOUT_FLOOR, TIMEOUT_FACTOR = 60.0, 5.0
NEWEST, TIERED = 20, 15


def moving_average(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The mean and the number of the last values up to each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(RECENT - 1), 0)
    return df.withColumns({"recent_avg": F.avg(value).over(w), "recent_n": F.count(value).over(w)})


def nearest_rank(values: Column) -> Column:
    """The 75th percentile as the pipeline takes it: the ceiling of 0.75 (n + 1) in ascending order."""
    n = F.size(values)
    at = F.least(F.greatest(F.ceil(0.75 * (n + 1)).cast("int"), F.lit(1)), n)
    return F.when(n > 0, F.try_element_at(F.sort_array(values), at))


def dynamic_timeout(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The time limit before each row: a multiple of the percentile of earlier positive values, with a floor; a key with many rows goes to many tasks."""
    return running_rank.timeouts(df, key, order, value, TIMEOUT_FLOOR, TIMEOUT_FACTOR)


def snapshot(df: DataFrame, key: str, order: str, chunks: str, seconds: str, remaining: int) -> DataFrame:
    """Timing of each run: totals, means, the recent mean and what is left by estimate."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    recent = F.when((F.col("_rn") <= RECENT) & (F.col(chunks) > 0), F.col(seconds) / F.col(chunks))
    out = ranked.groupBy(key).agg(
        F.sum(chunks).alias("total_chunks"), F.count(F.lit(1)).alias("file_samples"), (F.sum(seconds) / F.sum(chunks)).alias("avg_chunk_seconds"),
        F.avg(chunks).alias("avg_chunks_per_file"), F.avg(recent).alias("recent_avg_seconds"), nearest_rank(F.collect_list(F.when(recent > 0, recent))).alias("p75"),
    )
    left = F.col("avg_chunks_per_file") * max(remaining, 0)
    return out.withColumns({"remaining_chunks": left, "remaining_seconds": left * F.col("avg_chunk_seconds")})


def progress(m: DataFrame, done: Column, seconds: float) -> DataFrame:
    """Percent, files a minute and the time left, from one aggregate row."""
    one = m.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("done"))
    per_minute = F.col("done") * 60.0 / seconds
    return one.select("total", "done", F.try_divide(F.col("done") * 100.0, F.col("total")).alias("percent"), per_minute.alias("files_per_minute"), F.try_divide((F.col("total") - F.col("done")) * 60.0, per_minute).alias("eta_seconds"))


def retain_newest(snapshots: DataFrame, n: int = NEWEST) -> DataFrame:
    order = Window.partitionBy("archive").orderBy(F.desc("modified"), "name")
    return snapshots.withColumn("kept", F.row_number().over(order) <= n)


def tiers(when: list[datetime], now: datetime, limit: int = TIERED) -> list[bool]:
    """Which snapshots of one archive, newest first, the tiered policy keeps: the plain rule, one after another.

    Three newest; then one a day for a week, one a week for thirty days, one a month beyond, where a kept snapshot also
    takes its week and month; the oldest of the last tier fill it up to four; the newest ``limit`` of all that stay.
    """
    if len(when) <= limit:
        return [True] * len(when)
    kept, used = set(range(3)), set()
    marks = lambda t: {("d", t.date()), ("w", t.strftime("%Y-%W")), ("m", t.strftime("%Y-%m"))}
    for i in kept:
        used |= marks(when[i])
    for i in range(3, len(when)):
        age, own = now - when[i], marks(when[i])
        tier = "d" if age <= timedelta(days=7) else "w" if age <= timedelta(days=30) else "m"
        if not any(k == tier and (k, v) in used for k, v in own):
            kept.add(i)
            # a tier takes its own slot and the coarser ones
            used |= {x for x in own if "dwm".index(x[0]) >= "dwm".index(tier)}
    old = [i for i in range(len(when)) if now - when[i] > timedelta(days=30)]
    short = 4 - sum(i in kept for i in old)
    kept |= set([i for i in reversed(old) if i not in kept and i >= 3][: max(0, short)])
    best = sorted(kept)[:limit]
    return [i in best for i in range(len(when))]


def retain_tiered(snapshots: DataFrame, now: datetime, limit: int = TIERED) -> DataFrame:
    """The tiered policy per archive by windows: a tier's slot goes to its newest snapshot, unless a finer tier's keeper has it."""
    age = F.unix_timestamp(F.lit(now.isoformat(" ")).cast("timestamp")) - F.col("modified").cast("double")
    week = F.floor((F.dayofyear("modified") + 6 - F.weekday("modified")) / 7)
    newest = Window.partitionBy("archive").orderBy(F.desc("modified"), "name")
    all_ = Window.partitionBy("archive")
    rows = snapshots.select("archive", "name", "modified").withColumns({
        "rn": F.row_number().over(newest), "many": F.count(F.lit(1)).over(all_), "d": F.date_format("modified", "yyyy-MM-dd"), "w": F.concat(F.year("modified"), F.lit("-"), week), "m": F.date_format("modified", "yyyy-MM"),
    })
    tier = F.when(F.col("rn") <= 3, 0).when(age <= 7 * 86400, 1).when(age <= 30 * 86400, 2).otherwise(3)
    rows = rows.withColumns({"tier": tier, "old": age > 30 * 86400}).withColumn("keep", F.col("tier") == 0)
    for level, slot in ((1, "d"), (2, "w"), (3, "m")):
        own = Window.partitionBy("archive", slot)
        taken = F.max(F.col("keep") & (F.col("tier") < level)).over(own)
        first = F.row_number().over(own.orderBy(F.col("tier") != level, "rn")) == 1
        rows = rows.withColumns({"_taken": taken, "_first": first}).withColumn("keep", F.col("keep") | ((F.col("tier") == level) & F.col("_first") & ~F.col("_taken")))
    spare = ~F.col("keep") & F.col("old") & (F.col("tier") > 0)
    short = 4 - F.sum((F.col("keep") & F.col("old")).cast("int")).over(all_)
    oldest = F.row_number().over(Window.partitionBy("archive").orderBy(~F.col("_spare"), F.desc("rn")))
    rows = rows.withColumns({"_spare": spare, "_short": short}).withColumn("keep", F.col("keep") | (F.col("_spare") & (oldest <= F.col("_short"))))
    place = F.sum(F.col("keep").cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_place", place).select("archive", "name", "modified", ((F.col("many") <= limit) | (F.col("keep") & (F.col("_place") <= limit))).alias("kept"))
