"""Orders, pages and counts of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_LIMIT, TOOL_MOST, PAGE_MOST, LIST_DEFAULT, LIST_MOST = 50, 500, 100, 100, 1_000


def _lower(x: str) -> Column:
    return F.lower(F.col(x))


#: Total orders by name; a caller appends its own tie-break.
ORDERS = {
    "corpus": lambda: [F.col("platform"), F.col("source_key"), F.col("id")],  # O1
    "newest": lambda: [F.col("posted_at").desc_nulls_last(), F.col("first_seen").desc_nulls_last(), F.col("company"), F.col("title")],  # O2
    "tool": lambda: [_lower("company"), _lower("title"), F.col("location"), F.col("url")],  # O3
    "sources": lambda: [_lower("company"), F.col("platform"), F.col("source_key")],  # O4
    "rows": lambda: [F.col("company"), F.col("platform"), F.col("source_key")],  # O5
    "health": lambda: [F.col("status"), _lower("company")],  # O6
}


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` on of a total order; limit 0 means all (O7). Spark keeps only
    offset + limit rows of each partition on the way."""
    out = df.orderBy(*order).offset(max(0, offset))
    return out.limit(limit) if limit > 0 else out


def clamp_page(limit: int, offset: int) -> tuple[int, int]:
    """A browser's page: limit in [1, 100], offset at least 0."""
    return min(max(limit, 1), PAGE_MOST), max(offset, 0)


def clamp_tool(limit: int, default: int = DEFAULT_LIMIT, most: int = TOOL_MOST) -> int:
    """O9, O10, O11."""
    return min(limit if limit > 0 else default, most)


def tool_page(df: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, Column]:
    """The page of a tool, and whether more rows match (as a column over count ``n``)."""
    n = clamp_tool(limit)
    return page(df, order, n), F.col("n") > n


def browser_states(include_closed: bool = False) -> list[str]:
    """The states that a browser's search shows unless it asks for closed rows too."""
    return ["open", "stale", *(["closed", "lapsed"] if include_closed else [])]


def matched_by_state(df: DataFrame) -> DataFrame:
    """How many rows match in each lifecycle state."""
    return df.groupBy("state").agg(F.count("*").alias("matched"))


def after(df: DataFrame, order: list[tuple[str, bool]], cursor: tuple, limit: int) -> DataFrame:
    """Keyset paging (O16): rows beyond ``cursor`` in an order of (column, ascending) pairs."""
    beyond, equal = F.lit(False), F.lit(True)
    for (column, up), value in zip(order, cursor, strict=True):
        x = F.col(column)
        beyond = beyond | (equal & ((x > F.lit(value)) if up else (x < F.lit(value))))
        equal = equal & (x == F.lit(value))
    return df.filter(beyond).orderBy(*[F.col(c) if up else F.col(c).desc() for c, up in order]).limit(limit)


def facets(df: DataFrame, dimensions: list[str], most: int = 50) -> DataFrame:
    """The commonest values of up to five dimensions, by count and then value.

    One pass: rows are expanded to (dimension, value) pairs, counted before the shuffle.
    """
    if len(dimensions) > 5:
        raise ValueError("five dimensions at most")
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("dimension").orderBy(F.desc("n"), F.col("value").asc_nulls_last()))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most)


def aggregate(df: DataFrame, dimensions: list[str], open_days: Column) -> DataFrame:
    """Counts, companies, median and P90 of days open by dimensions."""
    return df.groupBy(*dimensions).agg(
        F.count("*").alias("postings"),
        F.countDistinct("company").alias("companies"),
        F.percentile(open_days, 0.5).alias("median_open_days"),
        F.percentile(open_days, 0.9).alias("p90_open_days"),
    )


def stats(df: DataFrame) -> DataFrame:
    """G33."""
    return df.agg(
        F.count("*").alias("postings"),
        F.countDistinct("company").alias("companies"),
        F.countDistinct("platform", "source_key").alias("sources"),
        F.min("posted_at").alias("oldest"),
        F.max("posted_at").alias("newest"),
    )


def sample_errors(df: DataFrame, column: str = "error", most: int = 3) -> DataFrame:
    """The first few distinct errors in order."""
    return df.select(column).distinct().orderBy(column).limit(most)


def new_since(df: DataFrame, since: Column) -> DataFrame:
    """How many rows appeared after an instant."""
    return df.agg(F.count_if(F.coalesce("first_seen", "posted_at") > since).alias("new"))
