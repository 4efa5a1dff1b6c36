"""The registry of sources: pruning, interleaving, companies, platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.query import any_term, matching_sources, terms  # noqa: F401


def interleave(sources: DataFrame, order: str = "reg_idx") -> DataFrame:
    """Platforms take turns, each in registry order."""
    turn = F.row_number().over(W.partitionBy("platform").orderBy(order))
    return sources.withColumn("turn", turn)


def companies(sources: DataFrame, order: str = "reg_idx") -> DataFrame:
    """Each company once, whatever the case; the spelling registered first stays."""
    return sources.groupBy(F.lower("company").alias("folded")).agg(F.min_by("company", order).alias("company"))


def by_company(sources: DataFrame, order: str = "reg_idx") -> DataFrame:
    """Companies with their platforms and keys."""
    return sources.groupBy(F.lower("company").alias("folded")).agg(
        F.min_by("company", order).alias("company"),
        F.array_sort(F.collect_set("platform")).alias("platforms"),
        F.array_sort(F.collect_set("key")).alias("keys"),
    )


def platforms(sources: DataFrame) -> DataFrame:
    """Sources and companies of each platform."""
    return sources.groupBy("platform").agg(F.count("*").alias("sources"), F.countDistinct(F.lower("company")).alias("companies"))


def registry_totals(sources: DataFrame) -> DataFrame:
    """G12."""
    return sources.agg(F.countDistinct(F.lower("company")).alias("companies"), F.count("*").alias("sources"))


def on_platforms(sources: DataFrame, wanted: list[str], exact: bool = False) -> DataFrame:
    """Sources of these platforms, in any case unless ``exact`` (P23, P24); all for none."""
    names = [w for w in wanted if w.strip()] if exact else terms(wanted)
    return sources if not names else sources.filter((F.col("platform") if exact else F.lower("platform")).isin(names))


def several_platforms(sources: DataFrame) -> DataFrame:
    """Companies on more than one platform."""
    found = sources.groupBy(F.lower("company").alias("folded")).agg(F.countDistinct("platform").alias("n_platforms"))
    return found.filter("n_platforms > 1")


def retired(base_sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Sources of a corpus that the registry lacks and that aren't retired yet (P25)."""
    live = base_sources.filter(~F.coalesce("retired", F.lit(False)))
    return live.join(registry.select("platform", "key").distinct(), ["platform", "key"], "left_anti")


def known_split(sources: DataFrame, employers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources with and without an employer row."""
    fold = lambda df: df.withColumns({"__p": F.lower("platform"), "__k": F.lower("key")})
    keys = fold(employers).select("__p", "__k").distinct()
    left = fold(sources)
    return left.join(keys, ["__p", "__k"], "left_semi").drop("__p", "__k"), left.join(keys, ["__p", "__k"], "left_anti").drop("__p", "__k")


def health(probes: DataFrame, most: int = 100) -> DataFrame:
    """Status and capped count of each probed source."""
    status = F.when(F.col("errors") > 0, "failing").when(F.col("postings") == 0, "empty").otherwise("ok")
    return probes.withColumns({"status": status, "postings": F.least("postings", F.lit(most))})


def status_counts(runs: DataFrame) -> DataFrame:
    """G7."""
    return runs.groupBy("status").agg(F.count("*").alias("n"))


def failed_ratio(runs: DataFrame) -> DataFrame:
    """Failed sources and their share, 0 without sources."""
    bad = F.col("status") == "failed"
    return runs.agg(F.count_if(bad).alias("failed"), F.count("*").alias("sources"), F.coalesce(F.avg(bad.cast("double")), F.lit(0.0)).alias("ratio"))


def order_key(name: str) -> Column:
    return F.lower(F.col(name))
