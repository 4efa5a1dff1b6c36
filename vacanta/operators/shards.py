"""Sharded runs: affinity, costs, LPT plans, fail-closed merges."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashes import lines_id, source_set_id
from ..functions.urls import service_policy, source_host
from .corpus import read_text, write_text
from .dedupe import per_platform, union_summary
from .registry import failed_ratio
from .schedule import DEFAULT_COST_MS, clamp_cost

PLAN_FIELDS = ("schema_version", "plan_id", "source_set_id", "cost_model", "commit", "shards")
PLAN_VERSION, MANIFEST_VERSION, MAX_FAILED = 1, 2, 0.20
SAMPLE_STATUSES = ("complete", "failed", "truncated", "stopped")
TERMINAL = ("complete", "failed")


def affinity(sources: DataFrame) -> DataFrame:
    """Adds ``group``: the service of the host that a key names, if all keys of its platform
    name one, else the whole platform (F29)."""
    hosts = sources.withColumn("__host", tuple_host(F.col("key")))
    whole = W.partitionBy("platform")  # a platform has some thousands of sources
    all_hosts = F.min(F.col("__host").isNotNull().cast("int")).over(whole) == 1
    group = F.when(all_hosts, F.concat(F.lit("service:"), service_policy(F.col("__host"))["service"])).otherwise(F.concat(F.lit("platform:"), F.col("platform")))
    return hosts.withColumn("group", group).drop("__host")


def tuple_host(key: Column) -> Column:
    """The first part of a comma-separated key that is a host."""
    hosts = F.filter(F.transform(F.split(key, ","), source_host), lambda h: h.isNotNull())
    return F.when(F.size(hosts) > 0, F.element_at(hosts, 1))


def estimate_costs(runs: DataFrame) -> tuple[DataFrame, int]:
    """The median clamped duration of each source, and of all samples."""
    used = runs.filter(F.col("status").isin(*SAMPLE_STATUSES) & (F.col("duration_ms") > 0)).withColumn("cost", clamp_cost(F.col("duration_ms")))
    # the aggregate counts by value, so all of a platform's costs are never in one list
    middle = F.floor(F.percentile("cost", 0.5)).cast("long")
    each = used.groupBy("platform", "key").agg(middle.alias("cost"))
    over = used.agg(F.count("*"), middle).first()
    return each, int(over[1]) if over[0] else DEFAULT_COST_MS


@dataclass
class ShardPlan:
    shards: list[dict]
    source_set_id: str
    cost_model: str
    commit: str = ""
    schema_version: int = PLAN_VERSION
    plan_id: str = field(init=False)

    def __post_init__(self):
        self.plan_id = self._id()

    def _id(self) -> str:
        return lines_id(f"{s['index']}\t{p}\t{k}" for s in self.shards for p, k in s["sources"])

    def validate(self) -> None:
        """Version, indexes, each source once, the id recomputed."""
        if self.schema_version != PLAN_VERSION:
            raise ValueError(f"plan version {self.schema_version}, not {PLAN_VERSION}")
        if [s["index"] for s in self.shards] != list(range(len(self.shards))):
            raise ValueError("shards aren't numbered from 0")
        every = [x for s in self.shards for x in s["sources"]]
        if len(every) != len(set(every)):
            raise ValueError("a source is in two shards")
        if self._id() != self.plan_id:
            raise ValueError("the plan was changed after it was made")

    def check_sources(self, sources: list[tuple[str, str]]) -> None:
        """C4."""
        if source_set_id(sources) != self.source_set_id:
            raise ValueError("the registry isn't the one the plan was made for")

    def matrix(self) -> list[int]:
        """K13."""
        return [s["index"] for s in self.shards]


def plan(sources: DataFrame, shard_count: int, costs: DataFrame | None = None, unknown: int = DEFAULT_COST_MS, commit: str = "") -> ShardPlan:
    """Affinity groups by falling cost, each to the lightest shard (C1, C2). Group costs are
    summed in Spark; a row per source comes to the driver, which packs them one by one."""
    if shard_count < 1:
        raise ValueError("a plan needs a shard")
    grouped = affinity(sources)
    if costs is None:
        grouped = grouped.withColumn("cost", F.lit(1).cast("long"))
    else:
        grouped = grouped.join(costs.select("platform", "key", "cost"), ["platform", "key"], "left").withColumn("cost", F.coalesce("cost", F.lit(unknown)))
    rows = grouped.select("platform", "key", "group", "cost").collect()
    if not rows:
        raise ValueError("no sources to plan")
    if len({(r[0], r[1]) for r in rows}) != len(rows):
        raise ValueError("a source occurs twice")
    bins: dict[str, list] = {}
    for p, k, g, cost in rows:
        b = bins.setdefault(g, [0, []])
        b[0] += cost
        b[1].append((p, k))
    shards = [{"index": i, "estimated_ms": 0, "groups": [], "sources": []} for i in range(shard_count)]
    for g, (cost, members) in sorted(bins.items(), key=lambda x: (-x[1][0], x[0])):
        to = min(shards, key=lambda s: (s["estimated_ms"], s["index"]))
        to["estimated_ms"] += cost
        to["groups"].append(g)
        to["sources"] += members
    for s in shards:
        s["groups"].sort()
        s["sources"].sort()
    return ShardPlan(shards, source_set_id((p, k) for p, k, _, _ in rows), "uniform" if costs is None else "duration", commit)


def plan_text(made: ShardPlan) -> str:
    """A plan as JSON."""
    return json.dumps({f: getattr(made, f) for f in PLAN_FIELDS})


def write_plan(spark: SparkSession, path: str, made: ShardPlan) -> list[int]:
    """Writes a plan beside its place and renames it; returns the matrix of shards."""
    write_text(spark, path, plan_text(made))
    return made.matrix()


def read_plan(spark: SparkSession, path: str) -> ShardPlan:
    """A plan that passes its own checks."""
    text = read_text(spark, path)
    if text is None:
        raise ValueError(f"no plan at {path}")
    found = json.loads(text)
    if missing := [f for f in PLAN_FIELDS if f not in found]:
        raise ValueError(f"the plan lacks {missing[0]}")
    shards = [s | {"sources": [tuple(x) for x in s["sources"]]} for s in found["shards"]]
    made = ShardPlan(shards, found["source_set_id"], found["cost_model"], found["commit"], found["schema_version"])
    made.plan_id = found["plan_id"]
    made.validate()
    return made


def resolve_sources(planned: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry's rows of planned sources, in the plan's order; a planned source that the
    registry lacks is an error (J12). ``planned`` has platform, key and rank."""
    keys = ["platform", "key"]
    if lost := planned.join(registry, keys, "left_anti").orderBy("rank").limit(3).collect():
        raise ValueError("the registry lacks " + ", ".join(f"{r['platform']}/{r['key']}" for r in lost))
    return registry.join(planned.select(*keys, "rank"), keys).orderBy("rank")


def stamp_errors(manifests: DataFrame, expected: ShardPlan) -> DataFrame:
    """Why each shard's manifest can't be merged, null if it can (C6). ``manifests`` has
    shard, schema_version and struct stamp(index, count, plan_id, source_set_id, commit)."""
    s = lambda f: F.col("stamp")[f]
    error = (
        F.when(F.col("schema_version") != MANIFEST_VERSION, "schema-version")
        .when(F.col("stamp").isNull(), "no-stamp")
        .when(s("index") != F.col("shard"), "index")
        .when(s("count") != len(expected.shards), "count")
        .when(s("plan_id") != expected.plan_id, "plan")
        .when(s("source_set_id") != expected.source_set_id, "source-set")
        .when(s("commit") != expected.commit, "commit")
    )
    return manifests.select("shard", error.alias("error"))


def index_errors(manifests: DataFrame, shard_count: int) -> DataFrame:
    """Shards out of range, twice or missing."""
    counts = manifests.groupBy("shard").agg(F.count("*").alias("n"))
    wanted = manifests.sparkSession.range(shard_count).select(F.col("id").cast("int").alias("shard"), F.lit(True).alias("wanted"))
    both = counts.join(wanted, "shard", "full_outer")
    error = F.when(F.col("wanted").isNull(), "out-of-range").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "twice")
    return both.select("shard", error.alias("error")).filter("error IS NOT NULL")


def coverage_errors(planned: DataFrame, crawled: DataFrame) -> DataFrame:
    """Sources a shard crawled without being asked, or left out."""
    keys = ["shard", "platform", "key"]
    extra = crawled.select(keys).distinct().join(planned, keys, "left_anti").withColumn("error", F.lit("extra"))
    missing = planned.select(keys).distinct().join(crawled, keys, "left_anti").withColumn("error", F.lit("missing"))
    return extra.unionByName(missing)


def complete(manifests: DataFrame, runs: DataFrame) -> DataFrame:
    """Whether each shard's run is complete and all of its sources ended."""
    ended = runs.groupBy("shard").agg(F.bool_and(F.col("status").isin(*TERMINAL)).alias("ended"))
    return manifests.join(ended, "shard", "left").select("shard", ((F.col("status") == "complete") & F.coalesce("ended", F.lit(True))).alias("complete"))


def window(manifests: DataFrame) -> DataFrame:
    """The first start, last finish and longest budget."""
    return manifests.agg(F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"), F.max("budget_ms").alias("budget_ms"))


def merge(expected: ShardPlan, manifests: DataFrame, runs: DataFrame, keys: DataFrame, allow_partial: bool = False, max_failed: float = MAX_FAILED) -> dict:
    """The union of all shards, or an error (C5, C9). ``keys`` has shard, line, key, company,
    platform; ``manifests`` also postings, status, started_at, finished_at, budget_ms."""
    spark = keys.sparkSession
    expected.validate()
    planned = spark.createDataFrame([(s["index"], p, k) for s in expected.shards for p, k in s["sources"]], "shard int, platform string, key string")
    checks = [
        index_errors(manifests, len(expected.shards)),
        stamp_errors(manifests, expected).filter("error IS NOT NULL"),
        coverage_errors(planned, runs).select("shard", "error"),
        manifests.select("shard", "postings")
        .join(keys.groupBy("shard").agg(F.count("*").alias("n")), "shard", "left")
        .filter(F.coalesce("n", F.lit(0)) != F.col("postings"))
        .select("shard", F.lit("truncated").alias("error")),
    ]
    for check in checks:
        if bad := check.orderBy("shard").limit(10).collect():
            raise ValueError("merge refused: " + ", ".join(f"shard {r['shard']}: {r['error']}" for r in bad))
    unfinished = complete(manifests, runs).filter("NOT complete").count()
    failed, total, ratio = failed_ratio(runs).first()
    partial = bool(unfinished) or (max_failed >= 0 and ratio > max_failed)
    if partial and not allow_partial:
        raise ValueError(f"merge refused: {unfinished} shards unfinished, {failed} of {total} sources failed")
    found = union_summary(keys).first().asDict()
    return found | {"status": "partial" if partial else "complete", "per_platform": {r[0]: r[1] for r in per_platform(keys).collect()}}
