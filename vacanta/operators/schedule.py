"""Refresh planning under a time budget: estimates, admission, emit order, state folding.

Scores are columns. Admission and emit order depend on each choice before, over one row
per source, and run on the driver (some thousands of sources, as measured by the users).
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import lines_id
from .corpus import trailing_median

# Fixed values.
DEFAULT_COST_MS, MIN_COST_MS, MAX_COST_MS = 1_000, 1, 30 * 60 * 1_000
MAX_STALE, MAX_SHIFT, MIN_PARALLEL, SAMPLES = 4_000, 6, 1_000, 7


@dataclass(frozen=True)
class SchedulePolicy:
    target: timedelta = timedelta(hours=24)
    per_platform: dict = field(default_factory=dict)
    tick: timedelta = timedelta(hours=1)
    oblige_at: int = 3_000
    oblige_share: int = 50
    fill: int = 90
    cold_parallel: int = 4_000
    retire_after: timedelta = timedelta(days=90)


def _ms(d: timedelta) -> int:
    return int(d.total_seconds() * 1000)


def target_ms(platform: Column, policy: SchedulePolicy) -> Column:
    out = F.lit(_ms(policy.target))
    for name, d in policy.per_platform.items():
        out = F.when(platform == name, _ms(d)).otherwise(out)
    return out


def staleness(now: Column, last_success: Column, target: Column) -> Column:
    """Age over target in thousandths, 4000 at most and for sources never refreshed."""
    age = F.unix_millis(now) - F.unix_millis(last_success)
    milli = F.floor(age * 1000 / target)
    return F.when(last_success.isNull(), MAX_STALE).when(age <= 0, 0).otherwise(F.least(milli, F.lit(MAX_STALE))).cast("int")


def eligible(now: Column, last_attempt: Column, failures: Column, target: Column) -> Column:
    """Back-off: wait target * 2^min(failures, 6) since the last attempt (C14)."""
    wait = target * F.pow(F.lit(2), F.least(failures, F.lit(MAX_SHIFT))).cast("long")
    waited = F.unix_millis(now) - F.unix_millis(last_attempt) >= wait
    return (F.coalesce(failures, F.lit(0)) <= 0) | last_attempt.isNull() | waited


def clamp_cost(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(MIN_COST_MS)), F.lit(MAX_COST_MS))


def estimates(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cost and yield by platform, and over all (G20): the median cost, the 75th percentile yield."""
    costs = state.select("platform", F.explode("duration_ms").alias("x")).select("platform", clamp_cost(F.col("x")).alias("cost"))
    yields = state.select("platform", F.explode("postings").alias("x")).select("platform", F.greatest("x", F.lit(0)).alias("yield"))
    # both aggregates count by value: no list of all samples of a platform, or of all platforms
    middle = F.floor(F.percentile("cost", 0.5)).cast("int")
    rank75 = F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY yield)").cast("int")
    cost = costs.groupBy("platform").agg(middle.alias("p_cost"))
    out = yields.groupBy("platform").agg(rank75.alias("p_yield"))
    over = costs.agg(F.coalesce(middle, F.lit(0)).alias("g_cost"), F.count("*").alias("n_cost")).crossJoin(
        yields.agg(F.coalesce(rank75, F.lit(0)).alias("g_yield"), F.count("*").alias("n_yield"))
    )  # a row each
    return cost.join(out, "platform", "full_outer"), over


def scored(registry: DataFrame, state: DataFrame, now: datetime, policy: SchedulePolicy = SchedulePolicy()) -> DataFrame:
    """A row for each registered source with cost, yield, staleness, score, lane and whether it
    may be tried (C10, C15). ``registry`` has platform, key, company and group."""
    c, at = F.col, F.lit(now.replace(minute=0, second=0, microsecond=0) if policy.tick == timedelta(hours=1) else now)
    by_platform, over = estimates(state)
    have = state.select("platform", "key", "last_attempt", "last_success", "duration_ms", "postings", "consecutive_failures", F.lit(True).alias("known"))
    rows = registry.join(have, ["platform", "key"], "left").join(by_platform, "platform", "left").crossJoin(over)
    some = lambda x: F.size(F.coalesce(x, F.array().cast("array<int>"))) > 0
    own_cost = F.when(some(c("duration_ms")), trailing_median(F.transform("duration_ms", clamp_cost)))
    own_yield = F.when(some(c("postings")), trailing_median(F.transform("postings", lambda x: F.greatest(x, F.lit(0)))))
    cost = F.coalesce(own_cost, "p_cost", F.when(c("n_cost") > 0, c("g_cost")), F.lit(DEFAULT_COST_MS))
    gain = F.coalesce(own_yield, "p_yield", F.when(c("n_yield") > 0, c("g_yield")), F.lit(1))
    target = target_ms(c("platform"), policy)
    rows = rows.withColumns({"cost": cost.cast("long"), "yield": gain.cast("long"), "stale": staleness(at, c("last_success"), target)})
    score = F.floor(c("yield") * c("stale").cast("long") * 1000 / c("cost")).cast("long")
    return rows.withColumns(
        {
            "score": score,
            "lane": F.when(c("stale") >= policy.oblige_at, "aging").otherwise("value"),
            "may": F.coalesce(~c("known"), F.lit(True)) | eligible(at, c("last_attempt"), c("consecutive_failures"), target),
        }
    ).select("platform", "key", "company", "group", "cost", "yield", "stale", "score", "lane", "may", "last_attempt")


def group_parallelism(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """Busy time over span of each affinity group, the most over runs (G21). ``runs`` has run,
    platform, key, duration_ms, started_at, finished_at; ``groups`` platform, key, group (J14)."""
    c = F.col
    used = runs.filter((c("duration_ms") > 0) & c("started_at").isNotNull() & c("finished_at").isNotNull()).join(groups, ["platform", "key"])
    spans = used.groupBy("run", "group").agg(F.sum("duration_ms").alias("busy"), (F.unix_millis(F.max("finished_at")) - F.unix_millis(F.min("started_at"))).alias("span"))
    one = F.greatest(F.floor(c("busy") * 1000 / c("span")), F.lit(MIN_PARALLEL)).cast("long")
    return spans.filter("span > 0").groupBy("group").agg(F.max(one).alias("parallelism_milli"), F.count("*").alias("samples"))


@dataclass
class SchedulePlan:
    items: list[dict]
    deferred: list[dict]
    groups: list[dict]
    planned_ms: int
    global_capacity_ms: int
    plan_id: str


#: More milliseconds than any plan has.
ENDLESS = 1 << 62


@dataclass
class Room:
    """How much time a group, or the whole plan, may fill, and what fills it."""

    capacity: int
    reserve: int = 0
    planned: int = 0
    items: list[dict] = field(default_factory=list)

    def holds(self, cost: int, limit: int | None = None) -> bool:
        return self.planned + cost <= (self.capacity if limit is None else limit)

    def add(self, row: dict) -> None:
        self.planned += row["cost"]
        self.items.append(row)


def _name(row: dict) -> tuple:
    return row["platform"], row["key"]


def _age(row: dict) -> tuple:
    """Never tried first, then the longest ago."""
    return row["last_attempt"] is not None, row["last_attempt"] or datetime.min, _name(row)


def _why_not(row: dict, unbounded: bool) -> str | None:
    """What keeps a source out of any plan."""
    if not row["may"]:
        return "backoff"
    return "fresh" if unbounded and row["stale"] < 1000 else None


def _rounds(rooms: dict[str, Room]) -> list[dict]:
    """Groups take turns, the fullest first; in a group aging sources by age, then the
    dearest first."""
    order = lambda r: (0, *_age(r)) if r["lane"] == "aging" else (1, -r["cost"], _name(r))
    busy = sorted((g for g, room in rooms.items() if room.items), key=lambda g: (-rooms[g].planned, g))
    turns = [(turn, place, r) for place, g in enumerate(busy) for turn, r in enumerate(sorted(rooms[g].items, key=order))]
    return [r | {"rank": i} for i, (_, _, r) in enumerate(sorted(turns, key=lambda t: t[:2]))]


def admit(rows: list[dict], parallelism: dict[str, int], policy: SchedulePolicy, wall: timedelta | None, workers: int = 1, shards: int = 1, unbounded: bool = False) -> SchedulePlan:
    """Which sources a run may visit under group and global budgets (C11), and their order.

    Aging sources come first, up to their share of a group's budget; those beyond it compete
    for the rest of the budget before the others, which go by score.
    """
    bounded = wall is not None and wall > timedelta(0) and not unbounded
    if bounded and workers < 1:
        raise ValueError("a wall budget needs workers")
    wall_ms = _ms(wall) if bounded else 0
    deferred: list[dict] = []

    def put_off(row: dict, reason: str) -> None:
        deferred.append({"platform": row["platform"], "key": row["key"], "group": row["group"], "reason": reason})

    total, rooms, ready = Room(wall_ms * workers * shards // 100 * policy.fill if bounded else ENDLESS), {}, []
    for r in rows:
        if reason := _why_not(r, unbounded):
            put_off(r, reason)
            continue
        if r["group"] not in rooms:
            width = parallelism.get(r["group"], 0) or policy.cold_parallel
            capacity = wall_ms * width // 1000 * policy.fill // 100 if bounded else ENDLESS
            rooms[r["group"]] = Room(capacity, capacity // 100 * policy.oblige_share if bounded else capacity)
        if r["cost"] > rooms[r["group"]].capacity:
            put_off(r, "oversize")
        else:
            ready.append(r)

    later = []
    for r in sorted((r for r in ready if r["lane"] == "aging"), key=_age):
        room = rooms[r["group"]]
        if room.holds(r["cost"], room.reserve) and total.holds(r["cost"]):
            room.add(r)
            total.add(r)
        else:
            later.append(r)
    for r in later + sorted((r for r in ready if r["lane"] == "value"), key=lambda r: (-r["score"], _name(r))):
        if not total.holds(r["cost"]):
            put_off(r, "global-budget")
        elif not rooms[r["group"]].holds(r["cost"]):
            put_off(r, "group-budget")
        else:
            rooms[r["group"]].add(r)
            total.add(r)
    items = _rounds(rooms)
    deferred.sort(key=_name)
    plan_id = lines_id(f"{i:09d}\t{r['platform']}\t{r['key']}" for i, r in enumerate(items))
    groups = [{"group": g, "capacity": room.capacity, "reserve": room.reserve, "planned": room.planned} for g, room in sorted(rooms.items())]
    return SchedulePlan(items, deferred, groups, total.planned, total.capacity, plan_id)


def build(registry: DataFrame, state: DataFrame, groups: DataFrame, now: datetime, wall: timedelta | None, workers: int = 1, shards: int = 1, policy: SchedulePolicy = SchedulePolicy(), unbounded: bool = False) -> SchedulePlan:
    """One row per source comes to the driver, scored."""
    rows = [r.asDict() for r in scored(registry, state, now, policy).orderBy("platform", "key").collect()]
    width = {r["key"]: r["parallelism_milli"] for r in groups.collect()}
    return admit(rows, width, policy, wall, workers, shards, unbounded)


def gate(now: datetime, cost_ms: int, deadline: datetime) -> bool:
    """C16."""
    return now + timedelta(milliseconds=cost_ms) <= deadline


def push_sample(samples: Column, value: Column) -> Column:
    """The newest seven, oldest first."""
    grown = F.concat(F.coalesce(samples, F.array().cast("array<int>")), F.array(value.cast("int")))
    return F.when(F.size(grown) > SAMPLES, F.slice(grown, -SAMPLES, SAMPLES)).otherwise(grown)


def fold_state(state: DataFrame, runs: DataFrame, now: datetime) -> DataFrame:
    """The next state of sources that a run tells about (C17)."""
    c, at = F.col, F.lit(now)
    told = runs.filter(c("status").isin("complete", "failed", "truncated", "stopped") & (c("platform") != "") & (c("key") != ""))
    told = told.select("platform", "key", *[c(x).alias(f"r_{x}") for x in ("company", "status", "duration_ms", "postings", "error_class")], F.lit(True).alias("ran"))
    both, ran = state.join(told, ["platform", "key"], "full_outer"), F.coalesce("ran", F.lit(False))
    done, failed = ran & (c("r_status") == "complete"), ran & (c("r_status") == "failed")
    none = F.array().cast("array<int>")
    return both.select(
        "platform",
        "key",
        F.when(ran & (F.coalesce("r_company", F.lit("")) != ""), c("r_company")).otherwise(F.coalesce("company", F.lit(""))).alias("company"),
        F.coalesce("group", F.lit("")).alias("group"),
        F.when(ran, at).otherwise(c("last_attempt")).alias("last_attempt"),
        F.when(done, at).otherwise(c("last_success")).alias("last_success"),
        F.when(ran & (c("r_duration_ms") > 0), push_sample(c("duration_ms"), clamp_cost(c("r_duration_ms")))).otherwise(F.coalesce("duration_ms", none)).alias("duration_ms"),
        F.when(done, push_sample(c("postings"), F.greatest("r_postings", F.lit(0)))).otherwise(F.coalesce("postings", none)).alias("postings"),
        F.when(done, 0).when(failed, F.coalesce("consecutive_failures", F.lit(0)) + 1).otherwise(F.coalesce("consecutive_failures", F.lit(0))).cast("int").alias("consecutive_failures"),
        F.when(done, "").when(failed, c("r_error_class")).otherwise(F.coalesce("error_class", F.lit(""))).alias("error_class"),
        F.when(ran, False).otherwise(F.coalesce("retired", F.lit(False))).alias("retired"),
        F.when(~ran, c("retired_at")).alias("retired_at"),
    )


def fold_groups(groups: DataFrame, measured: DataFrame, now: datetime) -> DataFrame:
    """Group state with the largest parallelism ever measured."""
    new = measured.select(F.col("group").alias("key"), F.col("parallelism_milli").alias("m"), F.col("samples").alias("s"))
    both = groups.join(new, "key", "full_outer")
    return both.select(
        "key",
        F.greatest(F.coalesce("parallelism_milli", F.lit(0)), F.coalesce("m", F.lit(0))).cast("int").alias("parallelism_milli"),
        F.when(F.col("s").isNotNull(), F.lit(now)).otherwise(F.col("observed_at")).alias("observed_at"),
        (F.coalesce("samples", F.lit(0)) + F.coalesce("s", F.lit(0))).cast("int").alias("samples"),
    )


def reconcile(state: DataFrame, registry: DataFrame, now: datetime, policy: SchedulePolicy = SchedulePolicy()) -> DataFrame:
    """Retires sources that left the registry, restores those back, drops those long gone."""
    c, at = F.col, F.lit(now)
    both = state.join(registry.select("platform", "key", F.lit(True).alias("here")).distinct(), ["platform", "key"], "left")
    here, was = F.coalesce("here", F.lit(False)), F.coalesce("retired", F.lit(False))
    long_gone = ~here & was & c("retired_at").isNotNull() & (F.unix_millis(at) - F.unix_millis("retired_at") > _ms(policy.retire_after))
    out = both.filter(~F.coalesce(long_gone, F.lit(False)))
    return out.withColumn("retired_at", F.when(here, F.lit(None)).otherwise(F.coalesce(F.when(was, c("retired_at")), at))).withColumn("retired", ~here).drop("here")


def fold_all(state: DataFrame, groups: DataFrame, registry: DataFrame, manifests: list[DataFrame], now: datetime, policy: SchedulePolicy = SchedulePolicy()) -> tuple[DataFrame, DataFrame]:
    """Every shard's runs folded once, then groups, then the registry."""
    for runs in manifests:
        state = fold_state(state, runs, now)
    tagged = [runs.withColumn("run", F.lit(i)) for i, runs in enumerate(manifests)]
    if tagged:
        union = tagged[0]
        for more in tagged[1:]:
            union = union.unionByName(more)
        groups = fold_groups(groups, group_parallelism(union, registry.select("platform", "key", "group")), now)
    return reconcile(state, registry, now, policy), groups


def relabel(runs: DataFrame, deferred: DataFrame) -> DataFrame:
    """Sources that a plan put off are deferred, not unfinished."""
    marks = deferred.select("platform", "key", F.lit(True).alias("put_off")).distinct()
    both = runs.join(marks, ["platform", "key"], "left")
    waiting = F.coalesce("put_off", F.lit(False)) & (F.col("status") == "planned")
    return both.withColumn("status", F.when(waiting, "deferred").otherwise(F.col("status"))).drop("put_off")


def top_groups(items: DataFrame, n: int = 8) -> DataFrame:
    """The groups with the most planned time."""
    return items.groupBy("group").agg(F.sum("cost").alias("planned_ms"), F.count("*").alias("sources")).orderBy(F.desc("planned_ms"), "group").limit(n)


def plan_costs(items: list[dict]) -> dict[tuple[str, str], int]:
    """Costs for sharding a plan; the median stands for unknown sources (C20)."""
    costs = sorted(r["cost"] for r in items)
    n = len(costs)
    middle = (costs[n // 2] if n % 2 else (costs[n // 2 - 1] + costs[n // 2]) // 2) if n else DEFAULT_COST_MS
    return {(r["platform"], r["key"]): r["cost"] for r in items} | {("", ""): middle}


def queues_by_group(items: list[dict]) -> dict[str, list[dict]]:
    out = defaultdict(list)
    for r in items:
        out[r["group"]].append(r)
    return dict(out)
