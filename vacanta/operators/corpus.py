"""The corpus: identity, verdicts, the fold of a run, states, counts, storage.

A run is folded in DataFrames only: verdicts per source, an identity ladder per source, a
full outer join of stored and observed rows, and a second pass that lapses rows by the
next source states. Nothing posting-sized reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import corpus_id, dedupe_key, descriptor
from ..functions.urls import url_identity
from ..schema import CORPUS_ROWS, CORPUS_SOURCES, FLAT, POSTING
from .dedupe import first_wins, key_hash
from .storage import cut, hadoop_path

#: Versions of the stored layout, samples kept per source, runs kept in the history.
FORMAT, MIN_READER, IDENTITY, TRAILING, RUNS_KEPT = 1, 1, 1, 7, 90
LADDER = ("external", "requisition", "url", "descriptor")


@dataclass(frozen=True)
class Policy:
    """Each field has its own default."""

    empty_streak: int = 3
    min_ratio: float = 0.25
    missing_runs: int = 2
    lapse_after: timedelta = timedelta(days=90)
    freshness: timedelta = timedelta(hours=24)


def trailing_median(samples: Column) -> Column:
    """The middle of an int array, the floor of the mean of two (G17); 0 without samples."""
    s, n = F.array_sort(samples), F.size(samples)
    mid = F.floor(n / 2).cast("int")
    at = lambda i: F.element_at(s, i)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 0).when(n % 2 == 1, at(mid + 1)).otherwise(F.floor((at(mid) + at(mid + 1)) / 2)).cast("int")


def percentile_rank(samples: Column, p: int) -> Column:
    """Nearest rank of a sorted array, whole numbers only."""
    n = F.size(samples)
    at = F.greatest(F.lit(1), F.least(n, F.floor((n * p + 99) / 100).cast("int")))
    return F.when(n > 0, F.element_at(F.array_sort(samples), at)).otherwise(0)


def verdict(policy: Policy = Policy(), status="status", postings="postings", errors="errors", trailing="trailing", streak="empty_streak") -> Column:
    """Why a run is no evidence, or ok (L2)."""
    c = F.col
    median = trailing_median(F.coalesce(c(trailing), F.array().cast("array<int>")))
    return (
        F.when(c(status) != "complete", F.concat(F.lit("status:"), c(status)))
        .when(c(errors) > 0, "errors")
        .when(median <= 0, "ok")
        .when((c(postings) == 0) & (F.coalesce(c(streak), F.lit(0)) + 1 < policy.empty_streak), "empty-streak-too-short")
        .when((c(postings) > 0) & (c(postings) < median * policy.min_ratio), "volume-drop")
        .otherwise("ok")
    )


def last_seen(row: Column, closed: Column, last_qualifying: Column) -> Column:
    """L4."""
    return F.coalesce(closed["last_seen"], row, last_qualifying)


def state(closed: Column, last_qualifying: Column, now: Column, policy: Policy = Policy()) -> Column:
    """open, stale, closed or lapsed at an instant (L3)."""
    age = F.unix_micros(now) - F.unix_micros(last_qualifying)
    micros = lambda d: int(d.total_seconds() * 1_000_000)
    return (
        F.when(closed.isNotNull() & (closed["reason"] == "absent"), "closed")
        .when(closed.isNotNull(), "lapsed")
        .when(last_qualifying.isNull(), "lapsed")
        .when(age >= micros(policy.lapse_after), "lapsed")
        .when(age >= micros(policy.freshness), "stale")
        .otherwise("open")
    )


def identify(postings: DataFrame, unsafe: DataFrame | None = None, order: str = "_seq") -> DataFrame:
    """Adds basis, value and id by the identity ladder (L1).

    A rung serves a source only if all its values there differ; requisitions also need a
    source that never had them repeated. ``postings`` has platform, key and the posting's
    fields; ``unsafe`` has (platform, key, requisition_unsafe). Also adds ``demoted``.
    """
    c = F.col
    text = lambda x: F.when(F.coalesce(c(x), F.lit("")) != "", c(x))
    rows = postings.withColumns(
        {
            "__external": text("external_id"),
            "__requisition": text("requisition_id"),
            "__url": F.when(F.coalesce(c("url"), F.lit("")) != "", url_identity(c("url"))),
            "__descriptor": descriptor(c("title"), c("location")),
        }
    )
    # Distinct values, as 128-bit hashes, are counted in two aggregations that combine before
    # their shuffles.
    rungs = LADDER[:3]
    value = lambda r: F.struct(F.lit(r).alias("rung"), c(f"__{r}").isNotNull().alias("has"), *[h.alias(n) for h, n in zip(key_hash(c(f"__{r}")), "ab", strict=True)])
    pairs = rows.select("platform", "key", F.explode(F.array(*[value(r) for r in rungs])).alias("p")).filter("p.has")
    per_value = pairs.groupBy("platform", "key", "p.rung", "p.a", "p.b").agg(F.count("*").alias("n"))
    usable = per_value.groupBy("platform", "key").agg(*[(F.max(F.when(c("rung") == r, c("n"))) <= 1).alias(f"use_{r}") for r in rungs])
    rows = rows.join(usable, ["platform", "key"], "left")
    sticky = F.lit(False)
    if unsafe is not None:
        rows = rows.join(unsafe.select("platform", "key", "requisition_unsafe"), ["platform", "key"], "left")
        sticky = F.coalesce("requisition_unsafe", F.lit(False))
    may_requisition = F.coalesce("use_requisition", F.lit(True)) & ~sticky
    basis = (
        F.when(F.coalesce("use_external", F.lit(True)) & c("__external").isNotNull(), "external")
        .when(may_requisition & c("__requisition").isNotNull(), "requisition")
        .when(F.coalesce("use_url", F.lit(True)) & c("__url").isNotNull(), "url")
        .otherwise("descriptor")
    )
    value = reduce(lambda out, r: F.when(c("basis") == r, c(f"__{r}")).otherwise(out), LADDER, F.lit(None).cast("string"))
    rows = rows.withColumn("basis", basis).withColumn("value", value).withColumn("demoted", ~may_requisition)
    rows = rows.withColumn("id", corpus_id(c("platform"), c("key"), c("basis"), c("value")))
    return rows.drop(*[f"__{r}" for r in LADDER], *[f"use_{r}" for r in rungs], "requisition_unsafe")


def identified(postings: DataFrame, unsafe: DataFrame | None = None, order: str = "_seq") -> DataFrame:
    """One row for each source and id, the first arrival."""
    return first_wins(identify(postings, unsafe, order), ["platform", "key", "id"], [order])


def changed(old: Column, new: Column) -> Column:
    """Null-safe difference of two postings."""
    return ~old.eqNullSafe(new)


@dataclass
class Generation:
    """What a fold gives: rows with their outcome, next source states, churn, run record.
    ``states`` are the source states without the counts of their open rows."""

    rows: DataFrame
    sources: DataFrame
    churn: DataFrame
    verdicts: DataFrame
    states: DataFrame


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """L15."""
    return spark.createDataFrame([], CORPUS_ROWS), spark.createDataFrame([], CORPUS_SOURCES)


def check_run(runs: DataFrame, run_at: datetime | None) -> None:
    """A run needs a clock and names each source once."""
    if run_at is None:
        raise ValueError("a run needs its clock reading")
    if not runs.groupBy("platform", "key").count().filter("count > 1").isEmpty():
        raise ValueError("a source occurs twice in the run")


def fold(
    base_rows: DataFrame,
    base_sources: DataFrame,
    runs: DataFrame,
    postings: DataFrame,
    run_at: datetime,
    retired: DataFrame | None = None,
    policy: Policy = Policy(),
) -> Generation:
    """The next generation of a corpus (L5-L13). ``postings`` has the posting fields, struct
    ``source`` and ``_seq``; ``retired`` has (platform, key)."""
    check_run(runs, run_at)
    c = F.col
    at = F.lit(run_at.replace(microsecond=0))
    states = base_sources.select(c("source.platform").alias("platform"), c("source.key").alias("key"), *[x for x in base_sources.columns if x != "source"])
    # Verdicts by the prior state of each source
    memory = states.select("platform", "key", "trailing", "empty_streak", "last_qualifying", "requisition_unsafe")
    verdicts = runs.join(memory, ["platform", "key"], "left").withColumn("verdict", verdict(policy)).withColumn("qualifies", c("verdict") == "ok")
    # Verdicts and identities serve rows and source states alike: each is computed once.
    verdicts = cut(verdicts, "corpus-verdicts")
    seen = verdicts.select("platform", "key", "qualifies", c("last_qualifying").alias("was_qualifying"))
    # Postings of sources that the run doesn't name are rejected
    fields = [f.name for f in POSTING.fields if f.name != "source"]
    flat = postings.select(*fields, c("source.platform").alias("platform"), c("source.key").alias("key"), "_seq")
    known = flat.join(runs.select("platform", "key"), ["platform", "key"], "left_semi")
    found = cut(identified(known, memory.select("platform", "key", "requisition_unsafe")), "corpus-found")
    observed = found.select(
        "platform",
        "key",
        c("id").alias("n_id"),
        c("basis").alias("n_basis"),
        dedupe_key(c("url"), c("company"), c("title"), c("location")).alias("n_dedupe"),
        F.struct(*fields, F.struct("platform", "key").alias("source")).alias("n_posting"),
    )
    base = base_rows.withColumns({"platform": c("posting.source.platform"), "key": c("posting.source.key")})
    # An id is scoped to its source, so the join is on the id alone
    both = base.withColumnRenamed("platform", "b_platform").withColumnRenamed("key", "b_key").join(observed, c("id") == c("n_id"), "full_outer")
    both = both.withColumns({"platform": F.coalesce("b_platform", "platform"), "key": F.coalesce("b_key", "key")}).drop("b_platform", "b_key")
    both = both.join(seen, ["platform", "key"], "left")
    ok, old, new = F.coalesce("qualifies", F.lit(False)), c("id").isNotNull(), c("n_id").isNotNull()
    gone = old & ~new & c("closed").isNull() & ok
    missing = F.when(new, 0).when(gone, c("missing") + 1).otherwise(c("missing"))
    frozen = F.when(new, F.when(~ok, at)).when(gone, F.coalesce("last_seen", "was_qualifying")).otherwise(c("last_seen"))
    closes = gone & (missing >= policy.missing_runs)
    outcome = (
        F.when(~old, "new")
        .when(new & c("closed").isNotNull(), "reopened")
        .when(new & changed(c("posting"), c("n_posting")), "changed")
        .when(new, "unchanged")
        .when(closes, "closed")
        .when(gone, "missing")
        .otherwise("untouched")
    )
    closure = F.struct(frozen.alias("last_seen"), at.alias("confirmed_at"), F.lit("absent").alias("reason"))
    rows = both.select(
        F.coalesce("id", "n_id").alias("id"),
        F.coalesce("n_basis", "basis").alias("basis"),
        F.coalesce("n_dedupe", "dedupe_key").alias("dedupe_key"),
        F.coalesce("first_seen", at).alias("first_seen"),
        frozen.alias("last_seen"),
        F.coalesce(missing, F.lit(0)).cast("int").alias("missing"),
        (F.coalesce("reopens", F.lit(0)) + (new & old & c("closed").isNotNull()).cast("int")).cast("int").alias("reopens"),
        F.when(new, F.lit(None)).when(closes, closure).otherwise(c("closed")).alias("closed"),
        F.coalesce("n_posting", "posting").alias("posting"),
        outcome.alias("outcome"),
    )
    demoted = found.filter("demoted").select("platform", "key", F.lit(True).alias("now_unsafe")).distinct()
    sources = roll_forward(states, verdicts, demoted, retired, at)
    return _lapsed(rows, sources, at, policy, verdicts)


def roll_forward(states: DataFrame, verdicts: DataFrame, demoted: DataFrame, retired: DataFrame | None, at: Column) -> DataFrame:
    """The next state of every source."""
    c = F.col
    run = verdicts.select(
        "platform",
        "key",
        c("company").alias("r_company"),
        c("status").alias("r_status"),
        c("postings").alias("r_postings"),
        c("errors").alias("r_errors"),
        c("duration_ms").alias("r_duration"),
        "qualifies",
        F.lit(True).alias("ran"),
    )
    out = states.join(run, ["platform", "key"], "full_outer").join(demoted, ["platform", "key"], "left")
    gone = F.lit(False)
    if retired is not None:
        out = out.join(retired.select("platform", "key", F.lit(True).alias("r_retired")).distinct(), ["platform", "key"], "left")
        gone = F.coalesce("r_retired", F.lit(False))
    ran = F.coalesce("ran", F.lit(False))
    clean = (c("r_status") == "complete") & (c("r_errors") == 0)
    ok = F.coalesce("qualifies", F.lit(False))
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    samples = F.concat(F.coalesce("trailing", F.array().cast("array<int>")), F.array(c("r_postings").cast("int")))
    samples = F.when(F.size(samples) > TRAILING, F.slice(samples, -TRAILING, TRAILING)).otherwise(samples)
    return out.select(
        F.struct("platform", "key").alias("source"),
        F.when(ran & (F.coalesce("r_company", F.lit("")) != ""), c("r_company")).otherwise(F.coalesce("company", F.lit(""))).alias("company"),
        (F.coalesce("retired", F.lit(False)) | gone).alias("retired"),
        F.when(ran, at).otherwise(c("last_attempt")).alias("last_attempt"),
        F.when(ok, at).otherwise(c("last_qualifying")).alias("last_qualifying"),
        F.when(ran, c("r_duration")).otherwise(c("last_duration_ms")).cast("long").alias("last_duration_ms"),
        F.when(ran, c("r_postings")).otherwise(c("last_postings")).cast("int").alias("last_postings"),
        F.when(ok, samples).otherwise(F.coalesce("trailing", F.array().cast("array<int>"))).alias("trailing"),
        F.when(ran & clean, F.when(c("r_postings") == 0, zero("empty_streak") + 1).otherwise(0)).otherwise(zero("empty_streak")).cast("int").alias("empty_streak"),
        F.when(ran & clean, 0).when(ran, zero("consecutive_failures") + 1).otherwise(zero("consecutive_failures")).cast("int").alias("consecutive_failures"),
        (F.coalesce("requisition_unsafe", F.lit(False)) | F.coalesce("now_unsafe", F.lit(False))).alias("requisition_unsafe"),
    )


def _lapsed(rows: DataFrame, sources: DataFrame, at: Column, policy: Policy, verdicts: DataFrame) -> Generation:
    """L9, with the next states; then open rows per source and churn."""
    c = F.col
    of = sources.select(c("source.platform").alias("platform"), c("source.key").alias("key"), "last_qualifying", "retired")
    joined = rows.withColumns({"platform": c("posting.source.platform"), "key": c("posting.source.key")}).join(of, ["platform", "key"], "left")
    micros = int(policy.lapse_after.total_seconds() * 1_000_000)
    due = c("closed").isNull() & c("last_qualifying").isNotNull() & (F.unix_micros(at) - F.unix_micros(c("last_qualifying")) >= micros)
    reason = F.when(c("retired"), "retired").otherwise("lapsed")
    closure = F.struct(F.coalesce("last_seen", "last_qualifying").alias("last_seen"), at.alias("confirmed_at"), reason.alias("reason"))
    joined = joined.withColumn("outcome", F.when(due, "lapsed").otherwise(c("outcome"))).withColumn("closed", F.when(due, closure).otherwise(c("closed")))
    joined = joined.withColumn("state", state(c("closed"), c("last_qualifying"), at, policy))
    kept = joined.drop("platform", "key", "last_qualifying", "retired")
    return Generation(kept, with_open(sources, kept), kept.groupBy("outcome").agg(F.count("*").alias("n")), verdicts, sources)


def with_open(states: DataFrame, rows: DataFrame) -> DataFrame:
    """Source states with how many of their rows are open."""
    still = rows.filter("state = 'open'").groupBy(F.col("posting.source").alias("__s")).agg(F.count("*").cast("int").alias("open"))
    joined = states.join(still, F.col("source") == F.col("__s"), "left").drop("__s")
    return joined.withColumn("open", F.coalesce("open", F.lit(0)))


def materialised(done: Generation) -> Generation:
    """The same generation written to the shared checkpoint folder: a later fold starts from
    the files, so plans don't grow from run to run."""
    rows = cut(done.rows, "corpus-rows")
    sources = cut(with_open(done.states, rows), "corpus-sources")
    return Generation(rows, sources, rows.groupBy("outcome").agg(F.count("*").alias("n")), done.verdicts, done.states)


def state_counts(rows: DataFrame) -> DataFrame:
    """Rows by state; open ones by distinct dedupe key."""
    s = F.col("state")
    return rows.agg(
        F.countDistinct(F.when(s == "open", F.col("dedupe_key"))).alias("open"),
        *[F.count_if(s == x).alias(x) for x in ("stale", "closed", "lapsed")],
        F.count("*").alias("rows"),
    )


def refusals(verdicts: DataFrame) -> DataFrame:
    """Refused runs by reason."""
    return verdicts.filter("verdict <> 'ok'").groupBy("verdict").agg(F.count("*").alias("n"))


def with_state(rows: DataFrame, sources: DataFrame, now: datetime, policy: Policy = Policy()) -> DataFrame:
    """Stored rows with last_seen and state at an instant."""
    c = F.col
    of = sources.select(c("source").alias("__s"), c("last_qualifying").alias("__q"))
    joined = rows.join(of, c("posting.source") == c("__s"), "left")
    out = joined.withColumn("state", state(c("closed"), c("__q"), F.lit(now), policy)).withColumn("seen", last_seen(c("last_seen"), c("closed"), c("__q")))
    return out.drop("__s", "__q")


def parse_states(values: str) -> list[str]:
    """A comma-separated list of states; all is all of them, and open is the default."""
    known = ["open", "stale", "closed", "lapsed"]
    wanted = [v.strip().lower() for v in values.split(",") if v.strip()] or ["open"]
    if bad := [v for v in wanted if v not in known and v != "all"]:
        raise ValueError(f"unknown state {bad[0]!r}")
    return known if "all" in wanted else wanted


def flat(rows: DataFrame) -> DataFrame:
    """The 33 stored columns in their order."""
    c = F.col
    p, pay = (lambda f: c("posting")[f]), (lambda f: c("posting.compensation")[f])
    millis = lambda x: F.coalesce(F.unix_millis(x), F.lit(0)).cast("long")
    made = {
        "first_seen": millis(c("first_seen")), "last_seen": millis(c("last_seen")), "closed_last_seen": millis(c("closed.last_seen")),
        "closed_confirmed_at": millis(c("closed.confirmed_at")), "closed_reason": F.coalesce("closed.reason", F.lit("")),
        "platform": c("posting.source.platform"), "source_key": c("posting.source.key"),
        "remote": F.when(p("remote").isNull(), 0).when(p("remote"), 2).otherwise(1),
        "posted_at": millis(p("posted_at")), "updated_at": millis(p("updated_at")),
        "compensation": c("posting.compensation").isNotNull().cast("int"),
    }
    for name in ("min", "max"):
        made[f"compensation_{name}"] = F.coalesce(pay(name), F.lit(0.0))
    for name in ("currency", "period", "summary", "provenance"):
        made[f"compensation_{name}"] = F.coalesce(pay(name), F.lit(""))
    for name in FLAT:
        if name not in made:
            made[name] = c(name) if name in rows.columns else F.coalesce(p(name), F.lit(""))
    return rows.select(*[made[n].alias(n) for n in FLAT])


# ------------------------------------------------------------------ storage


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """A small file, written beside its place and renamed into it."""
    path, fs = hadoop_path(spark, name)
    part, _ = hadoop_path(spark, name + ".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(path):
        fs.delete(path, False)
    if not fs.rename(part, path):
        raise OSError(f"could not publish {name}")


def read_text(spark: SparkSession, name: str) -> str | None:
    path, fs = hadoop_path(spark, name)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _digest_columns(rows: DataFrame) -> list[Column]:
    text = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    word = lambda i: F.conv(F.substring(text, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    return [F.count("*").alias("rows"), *[F.sum(word(i)).alias(f"sum{i}") for i in range(4)]]


def _digest_text(got) -> str:
    return "-".join(str(got[x] or 0) for x in ("rows", "sum0", "sum1", "sum2", "sum3"))


def digest(rows: DataFrame) -> str:
    """A digest of the rows, whatever their partitions: sums of row hashes."""
    return _digest_text(rows.agg(*_digest_columns(rows)).first())


def _summary(rows: DataFrame) -> tuple[dict, dict, str]:
    """Counts by state, counts by outcome and the digest of stored rows: two passes."""
    outcomes = ("new", "reopened", "changed", "unchanged", "closed", "missing", "untouched", "lapsed")
    got = rows.agg(*_digest_columns(rows), *[F.count_if(F.col("outcome") == x).alias(f"n_{x}") for x in outcomes]).first()
    churn = {x: got[f"n_{x}"] for x in outcomes if got[f"n_{x}"]}
    return state_counts(rows).first().asDict(), churn, _digest_text(got)


def publish(directory: str, number: int, generation: Generation, run_at: datetime, history: list[dict] | None = None) -> dict:
    """Rows and sources of a generation, then the manifest that commits it (K8, K9).

    Rows are dealt by range of (platform, key) and sorted, so row groups hold few sources.
    """
    spark, c = generation.rows.sparkSession, F.col
    rows = generation.rows.withColumns({"platform": c("posting.source.platform"), "source_key": c("posting.source.key")})
    folder = f"gen={number}-{uuid.uuid4().hex[:8]}"  # a run that was cut short leaves no rows behind in it
    at = f"{directory.rstrip('/')}/{folder}"
    dealt = rows.repartitionByRange("platform", "source_key", "id").sortWithinPartitions("platform", "source_key", "id")
    dealt.write.parquet(f"{at}/postings")
    stored = spark.read.parquet(f"{at}/postings")
    with_open(generation.states, stored).write.parquet(f"{at}/sources")
    counts, churn, checksum = _summary(stored)
    record = {"run_at": run_at.isoformat(), "counts": counts, "churn": churn}
    manifest = {
        "format": FORMAT, "min_reader": MIN_READER, "identity": IDENTITY, "generation": number, "run_at": run_at.isoformat(), "rows": counts["rows"],
        "counts": counts, "digest": checksum, "folder": folder, "runs": [*(history or []), record][-RUNS_KEPT:],
    }
    write_text(spark, f"{directory.rstrip('/')}/_manifest.json", json.dumps(manifest))
    return manifest


def open_corpus(spark: SparkSession, directory: str) -> tuple[dict | None, DataFrame, DataFrame]:
    """Manifest, rows and sources; empty ones only where no manifest is."""
    text = read_text(spark, f"{directory.rstrip('/')}/_manifest.json")
    if text is None:
        return None, *empty(spark)
    manifest = json.loads(text)
    if manifest["min_reader"] > FORMAT:
        raise ValueError(f"this corpus needs a reader of version {manifest['min_reader']}")
    at = f"{directory.rstrip('/')}/{manifest['folder']}"
    rows, sources = spark.read.parquet(f"{at}/postings"), spark.read.parquet(f"{at}/sources")
    if (n := rows.count()) != manifest["rows"]:
        raise ValueError(f"the corpus has {n} rows; its manifest says {manifest['rows']}")
    return manifest, rows, sources


def verify(spark: SparkSession, directory: str) -> None:
    """Version, rows, digest, and each source once."""
    manifest, rows, sources = open_corpus(spark, directory)
    if manifest is None:
        raise ValueError("no corpus here")
    if digest(rows) != manifest["digest"]:
        raise ValueError("the rows don't have the digest of the manifest")
    if not sources.groupBy("source").count().filter("count > 1").isEmpty():
        raise ValueError("a source occurs twice")


def inspect(spark: SparkSession, directory: str, last: int = 5) -> dict | None:
    """The manifest with its last runs, from metadata alone."""
    text = read_text(spark, f"{directory.rstrip('/')}/_manifest.json")
    if text is None:
        return None
    manifest = json.loads(text)
    return manifest | {"runs": manifest["runs"][-last:]}
