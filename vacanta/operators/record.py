"""The daily record of postings: series, guards, gaps, streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_SOURCE_SHARE, MIN_POSTING_SHARE, MIN_POSTINGS, MIN_SOURCES = 0.6, 0.5, 1_000, 100


def parse(lines: DataFrame) -> DataFrame:
    """day, postings, sources, status from ``value`` lines of 3 or 4 columns; ? is unknown."""
    parts = F.split(F.trim("value"), r"\s+")
    number = lambda i: F.when(parts[i] != "?", F.try_to_number(parts[i], F.lit("999999999999")).cast("long"))
    good = lines.filter(~F.trim("value").startswith("#") & F.size(parts).isin(3, 4))
    return good.select(F.to_date(parts[0], "MM/dd/yy").alias("day"), number(1).alias("postings"), number(2).alias("sources"), F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit("complete")).alias("status"))


def one_per_day(rows: DataFrame) -> DataFrame:
    """A complete row supersedes a partial one of its day; then the larger stays."""
    rank = F.struct((F.col("status") != "complete").cast("int"), -F.coalesce("postings", F.lit(-1)), -F.coalesce("sources", F.lit(-1)))
    best = rows.groupBy("day").agg(F.min_by(F.struct("postings", "sources", "status"), rank).alias("r"))
    return best.select("day", "r.*")


def islands(rows: DataFrame) -> DataFrame:
    """A number for each unbroken run of complete days; partial or unknown rows break it.
    A series has one row a day, so one window over it stays small."""
    gap = ((F.col("status") != "complete") | F.col("postings").isNull()).cast("int")
    return rows.withColumn("gap", gap).withColumn("island", F.sum("gap").over(W.orderBy("day")))


def guarded(rows: DataFrame) -> DataFrame:
    """Whether a row falls too far below the one recorded before."""
    before = W.orderBy("day")
    last = lambda x: F.last(F.when(F.col("status") == "complete", F.col(x)), ignorenulls=True).over(before.rowsBetween(W.unboundedPreceding, -1))
    low = (
        (F.col("sources") < MIN_SOURCES)
        | (F.col("postings") < MIN_POSTINGS)
        | (F.col("sources") < MIN_SOURCE_SHARE * last("sources"))
        | (F.col("postings") < MIN_POSTING_SHARE * last("postings"))
    )
    return rows.withColumn("suspect", F.coalesce(low, F.lit(False)))


def series(rows: DataFrame) -> DataFrame:
    """The most postings per status and the latest complete row."""
    done = F.col("status") == "complete"
    return rows.agg(
        F.max(F.when(done, F.col("postings"))).alias("max_complete"),
        F.max(F.when(~done, F.col("postings"))).alias("max_partial"),
        F.max(F.when(done, F.col("day"))).alias("latest"),
        F.max_by("postings", F.when(done, F.col("day"))).alias("latest_postings"),
    )


def streaks(days: DataFrame, by: list[str]) -> DataFrame:
    """Runs of consecutive days per group: first day, last day, length."""
    w = W.partitionBy(*by).orderBy("day")
    island = F.date_sub(F.col("day"), F.row_number().over(w))
    return days.select(*by, "day").distinct().withColumn("island", island).groupBy(*by, "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("island")


def trailing(rows: DataFrame, by: list[str], column: str, n: int = 7) -> DataFrame:
    """The last n values up to each day, oldest first."""
    return rows.withColumn("trailing", F.collect_list(column).over(W.partitionBy(*by).orderBy("day").rowsBetween(-(n - 1), 0)))


def record_row(totals: DataFrame, day, status: str) -> DataFrame:
    """MM/DD/YY POSTINGS COMPANIES STATUS."""
    text = F.concat_ws(" ", F.date_format(F.lit(day), "MM/dd/yy"), F.col("postings").cast("string"), F.col("companies").cast("string"), F.lit("" if status == "complete" else status))
    return totals.select(F.rtrim(text).alias("value"))
