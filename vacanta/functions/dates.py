"""Dates of job boards: relative words, layouts, epochs, day or month first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layouts tried in this order.
LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss 'UTC'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy")


def relative(raw: Column, now: Column) -> Column:
    """Posted Today, Yesterday or N Days Ago; 30+ tells too little."""
    text = F.lower(F.trim(raw))
    days = F.regexp_extract(text, r"^posted (\d+) days? ago$", 1)
    n = F.when(text == "posted today", 0).when(text == "posted yesterday", 1).when(days != "", F.try_to_number(days, F.lit("99999")).cast("int"))
    return F.date_sub(F.to_date(now), n).cast("timestamp")


def first_layout(raw: Column, layouts: tuple[str, ...] = LAYOUTS) -> Column:
    """The first layout that parses, null for none (F64)."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(raw), F.lit(x)) for x in layouts])


def slash_dates(df: DataFrame, source: list[str], column: str) -> DataFrame:
    """Adds ``parsed``: a/b/yyyy by the order that all dates of a source agree on (F65). If a
    first part exceeds 12 days come first; if a second one does, months; else neither is sure."""
    part = lambda i: F.try_to_number(F.regexp_extract(column, r"^(\d{2})/(\d{2})/(\d{4})$", i), F.lit("9999")).cast("int")
    rows = df.withColumns({"__a": part(1), "__b": part(2)})
    agreed = rows.groupBy(*source).agg((F.max("__a") > 12).alias("__day"), (F.max("__b") > 12).alias("__month"))
    both = rows.join(agreed, source, "left")
    parse = lambda layout: F.to_date(F.try_to_timestamp(column, F.lit(layout)))
    day, month = F.coalesce("__day", F.lit(False)), F.coalesce("__month", F.lit(False))
    return both.withColumn("parsed", F.when(day & ~month, parse("dd/MM/yyyy")).when(month & ~day, parse("MM/dd/yyyy"))).drop("__a", "__b", "__day", "__month")


def epoch(value: Column, millis: bool) -> Column:
    """zero and less are absent."""
    return F.when(value > 0, F.timestamp_millis(value) if millis else F.timestamp_seconds(value))


def encode(value: Column) -> Column:
    """Unix milliseconds, 0 for absent."""
    return F.coalesce(F.unix_millis(value), F.lit(0))


def decode(value: Column) -> Column:
    return F.when(value != 0, F.timestamp_millis(value))


def age_hours(now: Column, run_at: Column) -> Column:
    """F68."""
    return (F.unix_seconds(now) - F.unix_seconds(run_at)) / 3600


def since_label(age_days: Column) -> Column:
    """today, yesterday, or N days ago."""
    return F.when(age_days <= 0, "today").when(age_days == 1, "yesterday").otherwise(F.concat(age_days.cast("string"), F.lit(" days ago")))
