"""Boards that show only a window of results: slices by category, and by country where a
category fills the window (S35)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedupe import first_wins

#: Results that a board shows of one search.
WINDOW = 10_000


def slices(counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """The searches that together show every posting: (category, country or null, n).

    ``counts`` has category, country and n. A category below the window is one search; any
    other is searched country by country. Empty categories are not searched.
    """
    whole = counts.groupBy("category").agg(F.sum("n").alias("total"))
    small = whole.filter((F.col("total") > 0) & (F.col("total") < window)).select("category", F.lit(None).cast("string").alias("country"), F.col("total").alias("n"))
    large = counts.join(whole.filter(F.col("total") >= window), "category").filter(F.col("n") > 0).select("category", "country", "n")
    return small.unionByName(large)


def check_totals(by_category: DataFrame, by_country: DataFrame) -> int:
    """How many postings a board has; an error if its two facets disagree."""
    a, b = (f.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for f in (by_category, by_country))
    if a != b:
        raise ValueError(f"categories hold {a} postings, countries {b}")
    return a


def union(records: DataFrame) -> DataFrame:
    """Records (slice, place, url and others) of all searches, each URL once: the first seen stays."""
    return first_wins(records, ["url"], ["slice", "place"])
