"""Lifecycle, verdicts, identity, storage, shards, schedule, overlap, readers."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from vacanta.operators import corpus, dedupe, record, resolve, schedule, shards, sinks
from vacanta.schema import POSTINGS, SCHED_GROUPS, SCHED_SOURCES, SOURCE_RUNS
from vacanta.sources import fixture, readers

NOW = datetime(2026, 7, 29, 12, tzinfo=timezone.utc)
RUNS = [NOW - timedelta(days=100), NOW - timedelta(days=3), NOW - timedelta(hours=6)]


def posting(platform, key, company, n, title, location="", seq=0, **more):
    base = dict.fromkeys([f.name for f in POSTINGS.fields])
    url = f"https://example.com/{key}/jobs/{n}"
    return base | {"company": company, "url": url, "title": title, "location": location, "external_id": str(n), "source": {"platform": platform, "key": key}, "_seq": seq} | more


def run(platform, key, company, n, status="complete", errors=0):
    return {"platform": platform, "key": key, "company": company, "status": status, "started_at": None, "finished_at": None, "duration_ms": 5, "postings": n, "errors": errors, "error_class": ""}


ACME = [posting("greenhouse", "acme", "Acme", i, t, seq=i) for i, t in enumerate(["Senior Software Engineer", "Staff Security Engineer", "Marketing Manager", "Data Scientist", "Widget Painter"], 1)]
GLOBEX = [posting("ashby", "globex", "Globex", i, t, seq=10 + i) for i, t in enumerate(["Software Engineer, Platform", "Recruiter"], 1)]
INITECH = [posting("lever", "initech", "Initech", 1, "Site Reliability Engineer", seq=20)]
INPUTS = [
    (ACME + INITECH, [run("greenhouse", "acme", "Acme", 5), run("lever", "initech", "Initech", 1)]),
    (ACME[:4] + GLOBEX, [run("greenhouse", "acme", "Acme", 4), run("ashby", "globex", "Globex", 2)]),
    (ACME[:4], [run("greenhouse", "acme", "Acme", 4)]),
]


def fold_all(spark, inputs=INPUTS, clocks=RUNS, **more):
    rows, sources = corpus.empty(spark)
    done = None
    for (postings, runs), at in zip(inputs, clocks, strict=False):
        done = corpus.materialised(corpus.fold(rows, sources, spark.createDataFrame(runs, SOURCE_RUNS), spark.createDataFrame(postings, POSTINGS), at, **more))
        rows, sources = done.rows.drop("outcome", "state"), done.sources
    return done


@pytest.fixture(scope="module")
def three_runs(spark):
    return fold_all(spark)


def test_three_run_lifecycle(spark, three_runs):
    states = corpus.with_state(three_runs.rows.drop("state"), three_runs.sources, NOW)
    got = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
    assert got == {"open": 4, "stale": 2, "closed": 1, "lapsed": 1}


def test_partitioning_does_not_matter(spark, three_runs):
    shuffled = [(p[::-1], r) for p, r in INPUTS]
    again = fold_all(spark, shuffled)
    key = lambda g: sorted(map(str, corpus.flat(g.rows).collect()))
    assert key(three_runs) == key(again)


def test_failed_run_closes_nothing(spark):
    bad = [(ACME, [run("greenhouse", "acme", "Acme", 5)]), ([], [run("greenhouse", "acme", "Acme", 0, "failed")]), ([], [run("greenhouse", "acme", "Acme", 0, errors=1)])]
    done = fold_all(spark, bad, [NOW - timedelta(hours=h) for h in (3, 2, 1)])
    assert done.rows.filter("closed IS NOT NULL OR missing > 0").count() == 0
    assert [r["consecutive_failures"] for r in done.sources.collect()] == [2]


def test_reopen(spark):
    inputs = [(ACME, [run("greenhouse", "acme", "Acme", 5)])] + [(ACME[:4], [run("greenhouse", "acme", "Acme", 4)])] * 2 + [(ACME, [run("greenhouse", "acme", "Acme", 5)])]
    done = fold_all(spark, inputs, [NOW - timedelta(hours=h) for h in (4, 3, 2, 1)])
    row = done.rows.filter("posting.title = 'Widget Painter'").first()
    assert row["outcome"] == "reopened" and row["reopens"] == 1 and row["closed"] is None and row["missing"] == 0


def test_run_is_checked(spark):
    twice = spark.createDataFrame([run("p", "k", "c", 1)] * 2, SOURCE_RUNS)
    with pytest.raises(ValueError):
        corpus.check_run(twice, NOW)
    with pytest.raises(ValueError):
        corpus.check_run(twice.limit(1), None)


@pytest.mark.parametrize(
    "status,postings,errors,streak,history,want",
    [
        ("complete", 100, 0, 0, True, "ok"), ("failed", 9, 0, 0, True, "status:failed"), ("truncated", 9, 0, 0, True, "status:truncated"), ("complete", 100, 1, 0, True, "errors"),
        ("complete", 0, 0, 0, True, "empty-streak-too-short"), ("complete", 0, 0, 1, True, "empty-streak-too-short"), ("complete", 0, 0, 2, True, "ok"),
        ("complete", 24, 0, 0, True, "volume-drop"), ("complete", 25, 0, 0, True, "ok"), ("complete", 0, 0, 0, False, "ok"),
    ],
)
def test_verdicts(spark, status, postings, errors, streak, history, want):
    df = spark.createDataFrame([(status, postings, errors, [98, 101, 100, 99, 102, 100, 100] if history else None, streak)], "status string, postings int, errors int, trailing array<int>, empty_streak int")
    assert df.select(corpus.verdict()).first()[0] == want


def test_identity_ladder(spark):
    make = lambda **k: posting("p", "s", "C", k.pop("n"), "T", **k)
    rows = [
        make(n=1, external_id=None, requisition_id="R1", seq=1), make(n=2, external_id=None, requisition_id="R1", seq=2),
        make(n=3, external_id=None, requisition_id=None, seq=3), make(n=3, external_id=None, requisition_id=None, url="", location="x", seq=4),
    ]
    df = spark.createDataFrame(rows, POSTINGS).withColumns({"platform": F.col("source.platform"), "key": F.col("source.key")})
    got = corpus.identify(df).orderBy("_seq").collect()
    assert [r["basis"] for r in got] == ["url", "url", "url", "descriptor"] and all(r["demoted"] for r in got)
    same = spark.createDataFrame([make(n=1, url="", external_id=None, seq=1), make(n=2, url="", external_id=None, seq=2)], POSTINGS)
    same = same.withColumns({"platform": F.col("source.platform"), "key": F.col("source.key")})
    assert [r["_seq"] for r in corpus.identified(same).collect()] == [1]


def test_storage(spark, three_runs, tmp_path):
    at = str(tmp_path / "corpus")
    assert corpus.open_corpus(spark, at)[0] is None
    manifest = corpus.publish(at, 1, three_runs, RUNS[-1])
    assert manifest["rows"] == 8 and corpus.inspect(spark, at)["generation"] == 1
    corpus.verify(spark, at)
    _, rows, _ = corpus.open_corpus(spark, at)
    assert len(corpus.flat(rows).columns) == 33
    text = json.loads(corpus.read_text(spark, at + "/_manifest.json"))
    corpus.write_text(spark, at + "/_manifest.json", json.dumps(text | {"digest": "x"}))
    with pytest.raises(ValueError):
        corpus.verify(spark, at)


def test_stream_fold(spark, tmp_path):
    from vacanta.streaming.fold import fold_batch

    at = str(tmp_path / "stream")
    postings, runs = INPUTS[0]
    a = spark.createDataFrame(postings, POSTINGS).select(F.lit(RUNS[0]).alias("run_at"), F.struct("*").alias("posting"))
    b = spark.createDataFrame(runs, SOURCE_RUNS).select(F.lit(RUNS[0]).alias("run_at"), F.struct("*").alias("run"))
    batch = a.unionByName(b, allowMissingColumns=True)
    fold_batch(at, batch, 0)
    fold_batch(at, batch, 0)  # a repeated batch changes nothing
    manifest, rows, _ = corpus.open_corpus(spark, at)
    assert manifest["generation"] == 1 and rows.count() == 6


# ------------------------------------------------------------------ shards and schedule


def sources_frame(spark):
    rows = [("workday", f"https://t{i}.wd1.myworkdayjobs.com/x", f"W{i}") for i in range(4)] + [("greenhouse", f"g{i}", f"G{i}") for i in range(5)] + [("phenom", f"careers.c{i}.com", f"P{i}") for i in range(3)]
    return spark.createDataFrame(rows, "platform string, key string, company string")


def keys_for(plan, shared="same"):
    rows = []
    for s in plan.shards:
        rows += [(s["index"], j, f"{p}/{k}", "c", p) for j, (p, k) in enumerate(s["sources"])] + [(s["index"], 99, shared, "c", "x")]
    return rows


def artifacts(spark, plan, **change):
    stamp = {"count": len(plan.shards), "plan_id": plan.plan_id, "source_set_id": plan.source_set_id, "commit": plan.commit}
    manifests = [(s["index"], 2, {"index": s["index"], **stamp}, len(s["sources"]) + 1, "complete", None, None, 0) for s in plan.shards]
    runs = [(s["index"], p, k, "complete") for s in plan.shards for p, k in s["sources"]]
    if "manifests" in change:
        manifests = change["manifests"](manifests)
    if "runs" in change:
        runs = change["runs"](runs)
    kind = "shard int, schema_version int, stamp struct<index:int,count:int,plan_id:string,source_set_id:string,commit:string>, postings long, status string, started_at timestamp, finished_at timestamp, budget_ms long"
    return spark.createDataFrame(manifests, kind), spark.createDataFrame(runs, "shard int, platform string, key string, status string"), spark.createDataFrame(keys_for(plan), "shard int, line int, key string, company string, platform string")


def test_shard_plan_and_merge(spark):
    plan = shards.plan(sources_frame(spark), 3)
    plan.validate()
    again = shards.plan(sources_frame(spark).orderBy(F.desc("key")).repartition(3), 3)
    assert plan.plan_id == again.plan_id
    assert len({s["index"] for s in plan.shards for p, _ in s["sources"] if p == "greenhouse"}) == 1  # slugs share a backend
    got = shards.merge(plan, *artifacts(spark, plan))
    assert (got["postings"], got["duplicates"], got["status"]) == (13, 2, "complete")


REFUSALS = {
    "missing shard": {"manifests": lambda m: m[:-1]},
    "twice": {"manifests": lambda m: [*m, m[0]]},
    "out of range": {"manifests": lambda m: [*m, (9, *m[0][1:])]},
    "version": {"manifests": lambda m: [(m[0][0], 1, *m[0][2:]), *m[1:]]},
    "no stamp": {"manifests": lambda m: [(*m[0][:2], None, *m[0][3:]), *m[1:]]},
    "plan": {"manifests": lambda m: [(*m[0][:2], m[0][2] | {"plan_id": "x"}, *m[0][3:]), *m[1:]]},
    "truncated": {"manifests": lambda m: [(*m[0][:3], 99, *m[0][4:]), *m[1:]]},
    "unfinished": {"manifests": lambda m: [(*m[0][:4], "partial", *m[0][5:]), *m[1:]]},
    "omitted": {"runs": lambda r: r[1:]},
    "extra": {"runs": lambda r: [*r, (0, "x", "y", "complete")]},
    "failed": {"runs": lambda r: [(*x[:3], "failed") for x in r]},
}


@pytest.mark.parametrize("why", sorted(REFUSALS))
def test_merge_refuses(spark, why):
    plan = shards.plan(sources_frame(spark), 3)
    with pytest.raises(ValueError):
        shards.merge(plan, *artifacts(spark, plan, **REFUSALS[why]))


def test_schedule(spark):
    registry = spark.createDataFrame([("p", f"k{i}", "c", f"g{i % 2}") for i in range(8)], "platform string, key string, company string, `group` string")
    state = spark.createDataFrame([("p", f"k{i}", "c", "", NOW - timedelta(hours=30), NOW - timedelta(hours=30 + i), [1000 * (i + 1)], [10], 5 if i == 7 else 0, "", False, None) for i in range(1, 8)], SCHED_SOURCES)
    groups = spark.createDataFrame([], SCHED_GROUPS)
    ids = lambda plan: [(r["platform"], r["key"]) for r in plan.items]
    small = schedule.build(registry, state, groups, NOW, timedelta(seconds=5), workers=2)
    large = schedule.build(registry, state, groups, NOW, timedelta(seconds=50), workers=2)
    jitter = schedule.build(registry.repartition(3), state.orderBy(F.desc("key")), groups, NOW + timedelta(minutes=20), timedelta(seconds=5), workers=2)
    assert small.plan_id == jitter.plan_id and set(ids(small)) <= set(ids(large))
    assert {d["key"]: d["reason"] for d in small.deferred}["k7"] == "backoff"
    assert ids(large)[0] in [("p", "k0")]  # never attempted comes first in its group
    told = spark.createDataFrame([run("p", "k1", "C", 3), run("p", "k2", "", 0, "failed"), run("p", "k3", "", 0, "planned")], SOURCE_RUNS)
    next_state, _ = schedule.fold_all(state, groups, registry, [told], NOW)
    got = {r["key"]: r for r in next_state.collect()}
    assert got["k1"]["postings"] == [10, 3] and got["k2"]["consecutive_failures"] == 1 and got["k3"]["last_attempt"] != got["k1"]["last_attempt"]


def test_resolve_outcomes(spark):
    sources = [("p", "acmerobotics", "Acme Robotics"), ("p", "x1", "Twin"), ("p", "globex12", "https://globex"), ("p", "nmi", "NMI"), ("p", "rh", "RH"), ("p", "b1", "Beta Labs"), ("p", "betalabs", "Other Name")]
    entities = [(1, "Acme Robotics, Inc.", "", []), (2, "Twin Corp", "", []), (3, "Twin LLC", "", []), (4, "Globex", "", []), (5, "NMI Holdings", "NMIH", ["https://nationalmi.com"]), (6, "RH", "RH", []), (7, "Beta Labs", "", [])]
    got = resolve.resolve(spark.createDataFrame(sources, "platform string, key string, company string"), spark.createDataFrame(entities, "id int, name string, ticker string, websites array<string>"))
    assert {(r["key"], r["entity"]): r["outcome"] for r in got.collect()} == {
        ("acmerobotics", 1): "match", ("x1", 2): "ambiguous", ("x1", 3): "ambiguous", ("globex12", 4): "digit-trimmed", ("nmi", 5): "short-uncorroborated",
        ("rh", 6): "match", ("b1", 7): "contested", ("betalabs", 7): "contested",
    }


def test_overlap(spark):
    rows = [("a", "1", f"https://x.com/en-us/j/{i}/apply", f"REQ{i}") for i in range(6)] + [("b", "2", f"https://x.com/j/{i}", f"req{i} ") for i in range(6)] + [("c", "3", "https://y.com/z", "R")]
    facts = resolve.evidence(spark.createDataFrame(rows, "platform string, key string, url string, req string"))
    found = resolve.findings(resolve.overlaps(facts)).collect()
    assert [(r["a"], r["b"], r["raw"], r["url"], r["req"], r["strength"]) for r in found] == [("a/1", "b/2", 0, 6, 6, 1.0)]


def test_record(spark):
    lines = spark.createDataFrame([("# day",), ("07/22/20 ? 537",), ("07/25/26 13467 558",), ("07/26/26 473404 1772 partial",), ("07/26/26 480000 1800",), ("07/27/26 486210 1890 complete",)], "value string")
    days = record.one_per_day(record.parse(lines))
    assert [(r["postings"], r["status"]) for r in days.orderBy("day").collect()] == [(None, "complete"), (13467, "complete"), (480000, "complete"), (486210, "complete")]
    assert record.series(days).first()["latest_postings"] == 486210


# ------------------------------------------------------------------ readers and sinks


def test_readers(spark, tmp_path):
    tsv = tmp_path / "t.tsv"
    tsv.write_bytes("﻿# note\nplatform\tkey\tn\tok\r\np\tk\t\ttrue\r\nq\tl\t5\t\r\n".encode())
    rows = readers.typed(readers.tsv(spark, str(tsv), ["platform", "key", "n", "ok"]), {"n": "int", "ok": "boolean"}).orderBy("key").collect()
    assert [(r["n"], r["ok"]) for r in rows] == [(None, True), (5, None)]
    with pytest.raises(ValueError):
        readers.tsv(spark, str(tsv), ["other"])
    bad = tmp_path / "m.json"
    bad.write_text(json.dumps({"schema_version": 2}))
    with pytest.raises(Exception):
        readers.manifest(spark, str(bad)).collect()
    with pytest.raises(ValueError):
        readers.safe_name("../x")


def test_schedule_state_round_trip(spark, tmp_path):
    state = spark.createDataFrame([("p", "k", "c", "g", NOW, NOW, [1, 2], [3], 0, "", False, None)], SCHED_SOURCES)
    groups = spark.createDataFrame([("g", 4000, NOW, 1)], SCHED_GROUPS)
    at = str(tmp_path / "state")
    readers.state_lines(state, groups, "2026-07-29T12:00:00Z").coalesce(1).write.text(at)
    a, b, skipped = readers.schedule_state(spark, at)
    assert a.collect()[0]["duration_ms"] == [1, 2] and b.count() == 1 and skipped == 0
    assert readers.schedule_state_or_cold(spark, str(tmp_path / "none"))[0].count() == 0


def test_fixture_source(spark, tmp_path):
    for platform, key, pages in (("a", "one", ['{"x":1}', '{"x":2}']), ("a", "two", ["{broken"]), ("b", "three", ['{"x":3}', '{"x":3}'])):
        (tmp_path / platform / key).mkdir(parents=True)
        for i, p in enumerate(pages):
            (tmp_path / platform / key / f"page-{i}.ndjson").write_text(p + "\n")
    rows, runs = fixture.scan(spark, str(tmp_path))
    assert rows.count() == 3  # the repeated page stops its source
    assert {r["key"]: (r["status"], r["error_class"]) for r in runs.collect()} == {"one": ("complete", None), "two": ("failed", "JSONDecodeError"), "three": ("complete", None)}


def test_sinks(spark):
    pay = {"min": 1000.0, "max": 2000.0, "currency": "USD", "period": "month", "summary": "", "provenance": "employer"}
    df = spark.createDataFrame([posting("p", "k", "C", 1, "T", "Here", compensation=pay, workplace_type="remote", employment_type="contract", posted_at=NOW)], POSTINGS)
    assert df.select(sinks.detail(df)).first()[0] == " workplace: remote type: contract pay: USD 1000-2000/month posted: 2026-07-29"
    assert sinks.resolve_columns(None) == (list(sinks.CORE), False) and sinks.resolve_columns(["company", "posted_at"])[1]
    with pytest.raises(ValueError):
        sinks.resolve_columns(["nope"])
    row = sinks.csv_frame(df, extended=True).first()
    assert row["compensation"] == "USD 1000-2000/month" and row["posted_at"] == "2026-07-29T12:00:00Z" and row["remote"] == ""
    line = json.loads(sinks.json_lines(df).first()["value"])
    assert "department" not in line and line["company"] == "C"
    with pytest.raises(Exception):
        sinks.tsv_frame(spark.createDataFrame([("a\tb",)], "x string")).collect()


def test_first_wins_and_sites(spark):
    rows = [posting("p", "k", "C", 1, "b", "Rome", seq=2), posting("p", "k", "C", 1, "a", "Oslo", seq=1, remote=True), posting("p", "k", "C", 2, "c", "X", seq=0)]
    df = spark.createDataFrame(rows, POSTINGS)
    assert sorted(r["title"] for r in dedupe.dedupe(df).collect()) == ["a", "c"]
    site = dedupe.multi_site(df).filter("sites = 2").first()
    assert site["location"] == "Oslo; Rome" and site["remote"]
