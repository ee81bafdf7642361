"""Numbers and times for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", F.bround(x.cast("double"), 1))


def human_bytes(size: Column) -> Column:
    x = size.cast("double")
    out = F.when(x.isNull(), "Unknown")
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB", "PB")):
        out = out.when(x < 1024.0 ** (k + 1), F.concat(one_decimal(x / 1024.0**k), F.lit(f" {unit}")))
    return out.otherwise(F.concat(one_decimal(x / 1024.0**6), F.lit(" EB")))


def duration(seconds: Column) -> Column:
    total = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    h, m, s = F.floor(total / 3600).cast("long"), F.floor(total % 3600 / 60).cast("long"), total % 60
    parts = F.concat_ws(
        " ",
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))),
        F.when(m > 0, F.concat(m.cast("string"), F.lit("m"))),
        F.when((s > 0) | (h + m == 0), F.concat(s.cast("string"), F.lit("s"))),
    )
    return F.when(seconds.isNull(), DASH).otherwise(parts)


def seconds(x: Column) -> Column:
    return F.when(x.isNull(), DASH).otherwise(F.concat(one_decimal(x), F.lit("s")))


def rate(x: Column, unit: str) -> Column:
    return F.when(x.isNull() | (x <= 0), DASH).otherwise(F.concat(one_decimal(x), F.lit(f" {unit}" if unit else "")))


def eta(x: Column) -> Column:
    return F.when(x.isNull(), "Collecting").when(x <= 0, "Any moment now").otherwise(duration(x))


def modified_time(epoch: Column) -> Column:
    """Seconds since the epoch as local date and time; the session's time zone is local."""
    return F.when(epoch.isNull(), "Unknown").otherwise(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss"))


def source_name(path: Column) -> Column:
    """What a source is called: the last part of its path, else the path, else a fixed name."""
    given = F.coalesce(path, F.lit(""))
    return F.coalesce(F.nullif(F.regexp_extract(given, r"([^/]*)$", 1), F.lit("")), F.nullif(given, F.lit("")), F.lit("unknown-source"))


def correlation_id(path: Column) -> Column:
    """A short name for a file in logs, stable across runs; the path itself stays the key, as short names may collide."""
    return F.concat(F.lit("file-"), F.lpad(F.pmod(F.conv(F.substring(F.md5(path), 1, 8), 16, 10).cast("long"), F.lit(100_000)).cast("string"), 5, "0"))


def out_of(done: Column, total: Column) -> Column:
    """``n/m``; the number alone where the total is unknown, a dash where nothing is known."""
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.concat_ws("/", done.cast("string"), total.cast("string"))).when(F.coalesce(done, F.lit(0)) > 0, done.cast("string")).otherwise(DASH)


def bar_fill(ratio: Column, width: int = 40) -> Column:
    """Filled cells of a progress bar."""
    return F.when(ratio.isNull(), 0).otherwise(F.greatest(F.least(F.bround(ratio * width, 0).cast("int"), F.lit(width)), F.lit(0)))
