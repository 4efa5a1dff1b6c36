"""First-wins de-duplication, counts and unions of postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashes import dedupe_key, identity


def key_hash(*keys: Column) -> tuple[Column, Column]:
    """128 bits that stand for a key, nulls and all: fixed width, so grouping by them is cheap."""
    parts = [x for k in keys for x in (k.isNull(), k)]
    return F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts)


def first_wins(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order.

    Rows are ranked within 128-bit hashes of their keys. As only the first rank is asked
    for, Spark ranks before the shuffle as well and sends one row a key from each task, so
    a key with very many rows makes no large task.
    """
    a, b = key_hash(*[F.col(k) if isinstance(k, str) else k for k in keys])
    rank = F.row_number().over(W.partitionBy("__a", "__b").orderBy(*order))
    ranked = df.withColumns({"__a": a, "__b": b}).withColumn("__rank", rank)
    return ranked.filter(F.col("__rank") == 1).drop("__a", "__b", "__rank")


def dedupe(postings: DataFrame, order: Sequence[str | Column] = ("_seq",)) -> DataFrame:
    """One posting for each URL, or company, title and location; the first arrival stays (G1)."""
    c = F.col
    return first_wins(postings, [identity(c("url"), c("company"), c("title"), c("location"))], order)


def totals(postings: DataFrame, order: Sequence[str | Column] = ("_seq",)) -> DataFrame:
    """Postings and companies after de-duplication."""
    return dedupe(postings, order).agg(F.count("*").alias("postings"), F.countDistinct("company").alias("companies"))


def per_company(postings: DataFrame) -> DataFrame:
    """G3."""
    return postings.groupBy("company").agg(F.count("*").alias("n"))


def union_shards(keys: DataFrame) -> DataFrame:
    """One row for each key over all shards, from (shard, line, key, company, platform); the
    first in shard and line order wins (G4)."""
    return first_wins(keys, ["key"], ["shard", "line"])


def union_summary(keys: DataFrame) -> DataFrame:
    """Postings, companies and repeated keys of a union of shards."""
    winners = union_shards(keys).agg(F.count("*").alias("postings"), F.countDistinct("company").alias("companies"))
    counts = keys.agg((F.count("*") - F.countDistinct("key")).alias("duplicates"))
    return winners.crossJoin(counts)  # one row each


def per_platform(keys: DataFrame) -> DataFrame:
    return union_shards(keys).groupBy("platform").agg(F.count("*").alias("n"))


def with_keys(postings: DataFrame) -> DataFrame:
    """Adds ``dedupe_key``."""
    c = F.col
    return postings.withColumn("dedupe_key", dedupe_key(c("url"), c("company"), c("title"), c("location")))


def multi_site(postings: DataFrame, order: str = "_seq") -> DataFrame:
    """Rows that share a URL become one: remote if any is, sites in order of appearance."""
    # distinct sites with their first appearance come first: the list has no repeated ones
    named = postings.filter(F.coalesce("location", F.lit("")) != "").groupBy("url", "location").agg(F.min(order).alias("at"))
    sites = named.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "location"))), lambda s: s["location"]).alias("sites"))
    merged = postings.groupBy("url").agg(
        F.coalesce(F.bool_or("remote"), F.lit(False)).alias("remote"), F.min_by("title", order).alias("title"), F.count("*").alias("sites")
    )
    names = sites.select(F.col("url").alias("__url"), F.array_join("sites", "; ").alias("location"))
    joined = merged.join(names, F.col("url").eqNullSafe(F.col("__url")), "left").drop("__url")
    return joined.select("url", "remote", F.coalesce("location", F.lit("")).alias("location"), "title", "sites")
