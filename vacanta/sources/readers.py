"""Readers: NDJSON postings, manifests, strict TSV, schedule state, shard plans and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import hadoop_path
from ..schema import MANIFEST, POSTING, SCHED_GROUPS, SCHED_SOURCES

STATE_VERSION, MANIFEST_VERSION = 1, 2


def postings(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON postings; a malformed record is an error when the rows are read."""
    rows = spark.read.schema(POSTING).option("mode", "FAILFAST").option("timeZone", "UTC").json(path)
    return rows.withColumn("_seq", F.monotonically_increasing_id())


def shard_keys(spark: SparkSession, path: str) -> DataFrame:
    """key, company, platform; an empty key is an error."""
    rows = spark.read.schema("key string, company string, platform string").option("mode", "FAILFAST").json(path)
    return rows.withColumn("key", F.when(F.coalesce("key", F.lit("")) != "", F.col("key")).otherwise(F.raise_error(F.lit("a posting record without key"))))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a manifest; a missing list of sources is an error, not an empty one."""
    return with_sources(spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path))


def with_sources(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sources", F.when(F.col("sources").isNotNull(), F.col("sources")).otherwise(F.raise_error(F.lit("a manifest without sources"))))


def manifest_runs(frame: DataFrame) -> DataFrame:
    return frame.select(F.explode("sources").alias("s")).select("s.*")


def strings(rows: DataFrame, name: str) -> DataFrame:
    """One column as text; a missing one reads as empty."""
    return rows.select(F.col(name).alias(name) if name in rows.columns else F.lit("").alias(name))


def ints(rows: DataFrame, name: str) -> DataFrame:
    """One column of numbers; a missing one reads as 0."""
    return rows.select(F.col(name).alias(name) if name in rows.columns else F.lit(0).cast("long").alias(name))


def safe_name(name: str) -> str:
    """A file name that stays in its folder."""
    if not name or name.startswith(("/", ".")) or "\\" in name or ".." in name.split("/"):
        raise ValueError(f"a name must stay in its folder: {name!r}")
    return name


def tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Strict TSV: comments, a BOM and CR are skipped, the header and each row's width must
    be as wanted (S21). The lines are split by Spark; only the header comes to the driver."""
    lines = spark.read.text(path).select(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r$", "").alias("value"))
    lines = lines.filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    header = "\t".join(columns)
    if lines.filter(F.col("value") == header).limit(1).count() == 0:
        raise ValueError(f"{path} lacks the header {columns}")
    parts = F.split("value", "\t", -1)
    width = F.when(F.size(parts) == len(columns), parts).otherwise(F.raise_error(F.concat(F.lit(f"not {len(columns)} fields: "), F.col("value"))))
    return lines.filter(F.col("value") != header).select(width.alias("p")).select(*[F.trim(F.col("p")[i]).alias(n) for i, n in enumerate(columns)])


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Cells as int, double, boolean or list; blank is absent, and a bad cell an error."""
    for name, kind in kinds.items():
        cell = F.nullif(F.trim(name), F.lit(""))
        if kind == "list":
            df = df.withColumn(name, F.when(cell.isNull(), F.array().cast("array<string>")).otherwise(F.split(cell, r"\s+")))
        elif kind == "boolean":
            flag = F.when(F.lower(cell) == "true", True).when(F.lower(cell) == "false", False)
            df = df.withColumn(name, F.when(cell.isNull() | flag.isNotNull(), flag).otherwise(F.raise_error(F.concat(F.lit(f"not a Boolean in {name}: "), cell))))
        else:
            df = df.withColumn(name, cell.cast(kind))  # ANSI casts raise
    return df


def schedule_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """Sources, groups and how many records of unknown kinds were skipped."""
    text = spark.read.text(path).filter(F.trim("value") != "")
    kinds = text.withColumn("kind", F.get_json_object("value", "$.kind"))
    head = kinds.filter("kind = 'header'").select(F.get_json_object("value", "$.version").cast("int")).collect()
    if len(head) != 1:
        raise ValueError("a state file needs one header")
    if head[0][0] > STATE_VERSION:
        raise ValueError(f"state version {head[0][0]} is newer than {STATE_VERSION}")
    of = lambda kind, schema: kinds.filter(F.col("kind") == kind).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    skipped = kinds.filter(~F.coalesce("kind", F.lit("")).isin("header", "source", "group")).count()
    return of("source", SCHED_SOURCES), of("group", SCHED_GROUPS), skipped


def schedule_state_or_cold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Any damage means a cold start."""
    try:
        sources, groups, _ = schedule_state(spark, path)
        sources.count(), groups.count()
        return sources, groups
    except Exception:
        return spark.createDataFrame([], SCHED_SOURCES), spark.createDataFrame([], SCHED_GROUPS)


def state_lines(sources: DataFrame, groups: DataFrame, written_at: str) -> DataFrame:
    """Header, sources and groups, sorted, as JSON lines."""
    spark = sources.sparkSession
    head = spark.sql(f"SELECT 0 AS part, '' AS a, '' AS b, to_json(named_struct('kind', 'header', 'schema', 'schedule', 'version', {STATE_VERSION}, 'written_at', '{written_at}')) AS value")
    rows = sources.select(F.lit(1).alias("part"), F.col("platform").alias("a"), F.col("key").alias("b"), F.to_json(F.struct(F.lit("source").alias("kind"), *sources.columns)).alias("value"))
    more = groups.select(F.lit(2).alias("part"), F.col("key").alias("a"), F.lit("").alias("b"), F.to_json(F.struct(F.lit("group").alias("kind"), *groups.columns)).alias("value"))
    return head.unionByName(rows).unionByName(more).orderBy("part", "a", "b").select("value")


def merge_dir(spark: SparkSession, folder: str, shards: int) -> tuple[DataFrame, DataFrame]:
    """Manifests and keys of shard-N.json and shard-N.ndjson; a missing stream is an error."""
    number = F.regexp_extract(F.input_file_name(), r"shard-(\d+)\.", 1).cast("int")
    for i in range(shards):
        path, fs = hadoop_path(spark, f"{folder}/shard-{i}.ndjson")
        if not fs.exists(path):  # a stream is as large as its shard: only Spark reads it
            raise ValueError(f"shard {i} has no postings stream")
    manifests = manifest(spark, f"{folder}/shard-[0-9]*.json").withColumn("shard_index", number)
    keys = shard_keys(spark, f"{folder}/shard-[0-9]*.ndjson").withColumns({"shard": number, "line": F.monotonically_increasing_id()})
    return manifests, keys


def place_part(spark: SparkSession, folder: str, name: str) -> None:
    """Moves the one part file of a folder that Spark wrote to ``name``."""
    path, fs = hadoop_path(spark, folder)
    parts = [x.getPath() for x in fs.listStatus(path) if x.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{folder} has {len(parts)} part files")
    if not fs.rename(parts[0], hadoop_path(spark, name)[0]):
        raise OSError(f"could not place {name}")
    fs.delete(path, True)


def look_up(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of the wanted CIKs, merged (S29-S31). A table of facts needs no chunks of requests:
    the look-up is one join, and bindings of other CIKs don't reach the aggregate."""
    return merge_bindings(facts.join(wanted.select("cik").distinct(), "cik", "left_semi"))


def seed_ciks(rows: DataFrame) -> DataFrame:
    """One row for each CIK: the least row index, then ticker."""
    return rows.groupBy("cik").agg(F.min_by(F.struct("row_idx", "ticker", "name"), F.struct("row_idx", "ticker")).alias("r")).select("cik", "r.*")


def merge_bindings(rows: DataFrame) -> DataFrame:
    """Facts of a CIK from several bindings: the first non-blank of each, sites as a set."""
    first = lambda x: F.min(F.nullif(F.col(x), F.lit(""))).alias(x)
    return rows.groupBy("cik").agg(first("wikidata_id"), first("parent"), F.array_sort(F.collect_set(F.nullif("website", F.lit("")))).alias("websites"))


def dump_sources(rows: DataFrame) -> DataFrame:
    """Sources of a dump in order of appearance."""
    return rows.groupBy("platform", "key").agg(F.min("_seq").alias("first"), F.min_by("company", "_seq").alias("company"))
