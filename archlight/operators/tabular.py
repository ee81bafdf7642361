"""Profiles of tables: numeric columns, monthly trends, date detection, text of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archlight.functions import text as X

from .positions import numbered

#: Names that mark money columns and date columns.
FINANCE = "amount balance cost expense income price profit revenue sales total qty quantity".split()
TEMPORAL = "date datetime time timestamp modified created updated".split()
DATE_SHARE = 0.5


def metric_columns(df: DataFrame) -> list[str]:
    """Numeric and boolean columns, and those whose name speaks of money."""
    return [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType)) or any(w in f.name.lower() for w in FINANCE)]


def number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    return c.cast("int").cast("double") if isinstance(kind, T.BooleanType) else c.try_cast("double")


def numeric_profile(df: DataFrame) -> DataFrame:
    """``metric, total, mean, low, high`` of every metric column, in one pass over the table; columns without a number give no row."""
    names = metric_columns(df)
    aggs = [f(number(df, n)).alias(f"{k}_{i}") for i, n in enumerate(names) for k, f in (("s", F.sum), ("a", F.avg), ("l", F.min), ("h", F.max))]
    one = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"s_{i}").alias("total"), F.col(f"a_{i}").alias("mean"), F.col(f"l_{i}").alias("low"), F.col(f"h_{i}").alias("high")) for i, n in enumerate(names)))
    return one.select(F.col("n").alias("record_count"), F.explode(rows).alias("r")).select("r.*", "record_count").where("total is not null")


def date_column(df: DataFrame) -> str | None:
    """The first date column; else the first string column with a temporal name whose values parse for half the rows."""
    for f in df.schema:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return f.name
    named = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and any(w in f.name.lower() for w in TEMPORAL)]
    if not named:
        return None
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.try_to_timestamp(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(named))).first()
    return next((c for i, c in enumerate(named) if row[f"c{i}"] >= max(1, int(row["n"] * DATE_SHARE))), None)


def monthly_trend(df: DataFrame, date: str | None = None) -> DataFrame:
    """``month, metric, total``: sums per month of every metric column; months without a value give no row."""
    date = date or date_column(df)
    names = [n for n in metric_columns(df) if n != date]
    month = F.date_format(F.col(f"`{date}`") if isinstance(df.schema[date].dataType, (T.DateType, T.TimestampType)) else F.try_to_timestamp(F.col(f"`{date}`")), "yyyy-MM")
    sums = df.select(month.alias("month"), *(number(df, n).alias(f"m{i}") for i, n in enumerate(names))).where("month is not null").groupBy("month").agg(*(F.sum(f"m{i}").alias(f"m{i}") for i in range(len(names))))
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("total")) for i, n in enumerate(names)))
    return sums.select("month", F.explode(rows).alias("r")).select("month", "r.*").where("total is not null")


def ordered_values(df: DataFrame, name: str, order: str, by: list[str]) -> DataFrame:
    """Non-null values of a column as one text per group, in row order."""
    kept = df.where(F.col(f"`{name}`").isNotNull())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(f"`{name}`").cast("string").alias("v")))), lambda x: x["v"]), " ")
    return kept.groupBy(*by).agg(F.lit(name).alias("name"), text.alias("text"), F.count(F.lit(1)).alias("n")).where("n > 0").drop("n")


def table_text(df: DataFrame, columns: list[str], order: str, by: list[str]) -> DataFrame:
    """``name: values`` lines of the columns, for each group of rows; a column without values has no line. For small groups: ``text_parts`` holds no column in one value."""
    parts = reduce(DataFrame.unionByName, (ordered_values(df, c, order, by).withColumn("i", F.lit(i)) for i, c in enumerate(columns)))
    line = F.concat_ws(": ", "name", "text")
    return parts.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n").alias("table_text"))


#: Values of a part of a column's text.
PART = 10_000


def text_parts(df: DataFrame, columns: list[str], order: list[str], by: list[str] = (), part: int = PART) -> DataFrame:
    """``by, i, name, part, offset, n, text``: the non-null values of columns in row order as text, in parts of so many values.

    The parts of a column joined by a blank are its text, and ``offset`` is the place of a part in it, in characters. No
    row holds a column: values are numbered by ranges in many tasks, a part takes those of its numbers, and only the
    parts' lengths are summed up in order. Ties in ``order`` go by the value.
    """
    values = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(columns)))
    keys = [f"_by{k}" for k in range(len(by))]
    spread = df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)), *(F.col(f"`{c}`").alias(f"_o{k}") for k, c in enumerate(order)), F.explode(values).alias("x"))
    long = spread.where("x.v is not null").select(*keys, *(f"_o{k}" for k in range(len(order))), "x.*")
    placed = numbered(long, [*(f"_o{k}" for k in range(len(order))), "v"], [*keys, "i"], "_at").withColumn("part", F.floor(F.col("_at") / part))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "v"))), lambda x: x["v"]), " ")  # at most ``part`` values
    parts = placed.groupBy(*keys, "i", "name", "part").agg(F.count(F.lit(1)).alias("n"), text.alias("text"))
    earlier = Window.partitionBy(*keys, "i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lengths = parts.select(*keys, "i", "part", F.length("text").alias("l")).withColumn("offset", F.coalesce(F.sum(F.col("l") + 1).over(earlier), F.lit(0)))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "i", "part"]))
    told = parts.join(lengths.select(*(F.col(k).alias(f"_{k}") for k in [*keys, "i", "part"]), "offset"), same)
    return told.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), "i", "name", "part", "offset", "n", "text")


def flat_parts(df: DataFrame, order: list[str], by: list[str] = (), part: int = PART) -> DataFrame:
    """The parts of the string columns without a null, which are the text columns of ``flat_text``."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in by]
    nulls = df.agg(*(F.count_if(F.col(f"`{n}`").isNull()).alias(f"n{i}") for i, n in enumerate(names))).first() if names else []
    return text_parts(df, [n for n, k in zip(names, nulls) if not k], order, by, part)


def sheet_text(df: DataFrame, name: str, order: str) -> Column:
    """A sheet's rows as text, with its heading: an aggregate over the rows of a sheet."""
    row = F.concat_ws(" | ", *(F.col(f"`{c}`").cast("string") for c in df.columns if c != order))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))), lambda x: x["r"]), "\n")
    head = f"=== SHEET: {name} ===\nColumns: " + " | ".join(c for c in df.columns if c != order)
    return F.concat_ws("\n", F.lit(head), F.when(F.count(F.lit(1)) == 0, "(Empty sheet)").otherwise(rows))


def combined_text(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``name, table_text, i`` of named tables with their order columns; those without a value have an empty text, and stay here."""
    rows = []
    for i, (name, (df, order)) in enumerate(tables.items()):
        columns = [c for c in df.columns if c != order]
        one = table_text(df, columns, order, []) if columns else df.select(F.lit("").alias("table_text")).limit(0)
        rows.append(one.agg(F.coalesce(F.first("table_text"), F.lit("")).alias("table_text")).select(F.lit(name).alias("name"), "table_text", F.lit(i).alias("i")))
    return reduce(DataFrame.unionByName, rows)


def joined_tables(texts: DataFrame) -> DataFrame:
    """The texts of a file's tables under their headings, blank lines between; tables without text are left out."""
    entry = F.concat(F.lit("Table "), "name", F.lit(":\n"), "table_text")
    said = texts.where("table_text <> ''")
    return said.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", entry.alias("e")))), lambda x: x["e"]), "\n\n").alias("combined"))  # one entry for each table


def flat_text(df: DataFrame, order: str, by: list[str]) -> DataFrame:
    """Values of the string columns, a line for each column; a column with a null is no text column, as in the data frames this follows."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in by]
    nulls = df.agg(*(F.count_if(F.col(f"`{n}`").isNull()).alias(f"n{i}") for i, n in enumerate(names))).first() if names else []
    text = [n for n, k in zip(names, nulls) if not k]
    column = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(f"`{n}`").alias("v")))), lambda x: x["v"]), " ")
    return df.groupBy(*by).agg(F.concat_ws(" \n", *map(column, text)).alias("flat_text"))


def analyze_tables(tables: dict[str, tuple[DataFrame, str]], themes: int = 5, names: int = 10) -> DataFrame:
    """``i, name, table_text, summary, themes, entities, score, mood`` of a database's tables, given with their order columns."""
    text = F.col("table_text")
    told = combined_text(tables).withColumn("score", X.sentiment_score(text))
    themed = F.transform(X.themes(text, themes), lambda t: t["theme"])
    return told.select("i", "name", "table_text", X.summary(text).alias("summary"), themed.alias("themes"), X.entities(text, names).alias("entities"), "score", X.sentiment(F.col("score")).alias("mood"))
