"""Employer facts: overlay, wages, attachment, coverage."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.query import matching_sources
from ..sources import readers
from . import search

EMPLOYER_COLUMNS = "platform key company legal_name cik ticker exchange sic industry public employees founded headquarters parent wikidata_id method confidence".split()
WAGE_COLUMNS = "platform key soc occupation area source n p25 p50 p75 as_of".split()
#: Rows up to which employer facts are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _folded(platform: Column, key: Column) -> dict[str, Column]:
    return {"__p": F.lower(platform), "__k": F.lower(key)}


def overlay(generated: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual rows replace generated ones; refuted ones delete them."""
    key = lambda df: df.withColumns(_folded(F.col("source.platform"), F.col("source.key")))
    by_hand = key(manual)
    rest = key(generated).join(by_hand.select("__p", "__k").distinct(), ["__p", "__k"], "left_anti")
    kept = by_hand.filter(F.coalesce(F.col("match.method"), F.lit("")) != "refuted")
    return rest.unionByName(kept, allowMissingColumns=True).drop("__p", "__k")


def attach_wages(employers: DataFrame, wages: DataFrame) -> DataFrame:
    """Benchmarks as an array of their employer, ordered; those of no employer go."""
    fields = ["soc", "occupation", "area", "source", "n", "p25", "p50", "p75", "as_of"]
    grouped = (
        wages.withColumns(_folded(F.col("platform"), F.col("key")))
        .groupBy("__p", "__k")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("wage_benchmarks"))
    )
    left = employers.drop("wage_benchmarks").withColumns(_folded(F.col("source.platform"), F.col("source.key")))
    return left.join(grouped, ["__p", "__k"], "left").drop("__p", "__k")


def attach(postings: DataFrame, employers: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Postings with a nullable struct ``employer``, joined by source in any case; an empty
    source joins nothing (J1). A small table is broadcast after its size was checked."""
    facts = employers.withColumns(_folded(F.col("source.platform"), F.col("source.key")))
    facts = facts.filter((F.col("__p") != "") | (F.col("__k") != "")).dropDuplicates(["__p", "__k"])
    facts = facts.select("__p", "__k", F.struct(*employers.columns).alias("employer"))
    if facts.limit(broadcast_rows + 1).count() <= broadcast_rows:
        facts = F.broadcast(facts)
    left = postings.withColumns(_folded(F.col("source.platform"), F.col("source.key")))
    return left.join(facts, ["__p", "__k"], "left").drop("__p", "__k")


@dataclass
class Lookup:
    """A page of sources with their employer, and over all matches how many there are and how
    many of them have one."""

    rows: DataFrame
    counts: DataFrame


def lookup(sources: DataFrame, employers: DataFrame, companies: Iterable[str], limit: int = 0) -> Lookup:
    """Employers of the sources whose company or key holds a term (E9, O11). ``sources`` has
    platform, key and company; the page goes by company, platform and key."""
    found = matching_sources(sources, companies).withColumn("source", F.struct("platform", "key"))
    both = attach(found, employers)
    page = search.page(both.withColumn("source_key", F.col("key")), search.ORDERS["sources"](), search.clamp_tool(limit))
    counts = both.agg(F.count("*").alias("matched"), F.count_if(F.col("employer").isNotNull()).alias("known"))
    return Lookup(page.drop("source", "source_key"), counts)


def load(spark: SparkSession, generated: str, manual: str | None = None, wages: str | None = None) -> DataFrame:
    """Employer facts from TSV files: generated rows, overlaid by hand, with their wages."""
    read = lambda path: _employer_rows(readers.tsv(spark, path, EMPLOYER_COLUMNS))
    rows = read(generated) if manual is None else overlay(read(generated), read(manual))
    if wages is None:
        return rows
    kinds = {"n": "int", **dict.fromkeys(("p25", "p50", "p75"), "double")}
    return attach_wages(rows, readers.typed(readers.tsv(spark, wages, WAGE_COLUMNS), kinds))


def _employer_rows(cells: DataFrame) -> DataFrame:
    typed = readers.typed(cells, {"employees": "int", "founded": "int", "public": "boolean"})
    made = typed.withColumns({"source": F.struct("platform", "key"), "match": F.struct("method", "confidence")})
    return made.drop("platform", "key", "method", "confidence")


def flatten(postings: DataFrame) -> DataFrame:
    """P29."""
    return postings.drop("employer")


def coverage(sources: DataFrame, employers: DataFrame) -> DataFrame:
    """Sources that have an employer row, and all that aren't empty."""
    keys = employers.select(*[c.alias(n) for n, c in _folded(F.col("source.platform"), F.col("source.key")).items()], F.lit(True).alias("hit")).distinct()
    left = sources.filter((F.col("platform") != "") | (F.col("key") != "")).withColumns(_folded(F.col("platform"), F.col("key")))
    return left.join(keys, ["__p", "__k"], "left").agg(F.count_if(F.col("hit")).alias("matched"), F.count("*").alias("total"))
