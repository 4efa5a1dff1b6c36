"""Registered queries over whole tables against brute force."""

import json
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vacanta.functions.names import normalize, squashed
from vacanta.catalog.views import view
from vacanta.operators import resolve, sinks
from vacanta.registry import QUERIES, SQL
from vacanta.sources import readers

DATA, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.mark.parametrize("name", ["j07_proposals", "e07_examples"])
def test_whole_tables_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for n in ("part", "lineitem"):
        con.sql(f"create view {n} as select * from '{DATA}/{n}.parquet'")
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    got = Counter(map(tuple, got.select(columns).toPandas().itertuples(index=False, name=None)))
    assert got == Counter(map(tuple, con.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()))


def test_resolve_every_part(spark):
    part = spark.read.parquet(f"{DATA}/part.parquet")
    name = F.concat("p_name", F.lit(" Holdings, Inc."), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise(""))
    key, company = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_partkey").cast("string")), F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"))
    rows = part.select("p_partkey", key.alias("key"), normalize(company).alias("norm"), squashed(key).alias("squash"), normalize(name).alias("e_norm"), squashed(name).alias("e_squash")).collect()
    by_norm, by_squash = defaultdict(list), defaultdict(list)
    for r in rows:
        by_norm[r["e_norm"]].append(r)
        by_squash[r["e_squash"]].append(r)
    found = {}
    for r in rows:
        cut = r["squash"].rstrip("0123456789")
        tiers = (by_norm[r["norm"]], "exact-name", "high"), (by_squash[r["squash"]], "exact-key", "high"), (by_squash[cut] if cut != r["squash"] and len(cut) > 2 else [], "exact-key", "medium")
        for held, *how in tiers:
            for e in held:
                found.setdefault((r["key"], e["p_partkey"]), (*how, r["norm"], e["e_norm"]))
    readings = Counter(k for k, _ in found)
    names = defaultdict(set)
    for (_, e), v in found.items():
        names[e].add(v[2])
    want = Counter()
    for (k, e), (method, confidence, _, norm) in found.items():
        short = " " not in norm and len(norm.encode()) < 5
        outcome = "ambiguous" if readings[k] > 1 else "contested" if len(names[e]) > 1 else "digit-trimmed" if confidence != "high" else "short-uncorroborated" if short else "match"
        want[outcome, method, confidence] += 1
    got = {(r["outcome"], r["method"], r["confidence"]): r["n"] for r in QUERIES["e01_resolve"](spark, DATA).collect()}
    assert got == want and {r["p_partkey"] for r in rows if r["p_partkey"] >= 400} & {e for _, e in found}


def plain_fold(runs, seen):
    """Rows (missing, reopens, outcome, reason) after all days, by the rules of a fold."""
    rows, sources = {}, defaultdict(lambda: ([], 0))
    for day in sorted({r["day"] for r in runs}):
        ok = {}
        for r in (r for r in runs if r["day"] == day):
            trailing, streak = sources[r["key"]]
            a, n = sorted(trailing), len(trailing)
            median = 0 if not n else a[n // 2] if n % 2 else (a[n // 2 - 1] + a[n // 2]) // 2
            clean = r["status"] == "complete" and r["errors"] == 0
            few = median > 0 and (streak + 1 < 3 if r["postings"] == 0 else r["postings"] < 0.25 * median)
            ok[r["key"]] = clean and not few
            sources[r["key"]] = ((trailing + [r["postings"]])[-7:] if ok[r["key"]] else trailing, (streak + 1 if r["postings"] == 0 else 0) if clean else streak)
        for x in {*rows, *seen[day]}:
            missing, reopens, _, reason = rows.get(x, (0, 0, "", None))
            if x in seen[day]:
                rows[x] = (0, reopens + (reason is not None), "new" if x not in rows else "reopened" if reason else "unchanged", None)
            elif reason is None and ok.get(x[0]):
                rows[x] = (missing + 1, reopens, *(("closed", "absent") if missing + 1 >= 2 else ("missing", None)))
            else:
                rows[x] = (missing, reopens, "untouched", reason)
    return Counter(rows.values())


def test_fold_of_every_day(spark):
    seen = defaultdict(set)
    for r in spark.read.parquet(f"{SMALL}/events.parquet").select(F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("u"), "event_type").collect():
        seen[r["day"]].add((r["u"], r["event_type"]))
    want = plain_fold(view(spark, SMALL, "v_runs").collect(), seen)
    got = Counter((r["missing"], r["reopens"], r["outcome"], r["closed_reason"]) for r in QUERIES["l09_fold_all_days"](spark, SMALL).collect())
    assert got == want and sum(want.values()) == len(set().union(*seen.values()))
    assert any(k[3] for k in want)


def test_every_day_is_complete_as_in_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view events as select * from '{DATA}/events.parquet'")
    got = Counter((r["day"], r["shard"], r["complete"]) for r in QUERIES["c08_complete"](spark, DATA).collect())
    assert got == Counter(con.sql(f"select day, shard, complete from ({SQL['c08_complete']})").fetchall())


def test_every_finding_is_reported(spark, tmp_path):
    rows = [(f"p/{i}", f"q/{i}", i, 1, 2, (i + 1) / 200) for i in range(150)]
    found = spark.createDataFrame(rows, "a string, b string, raw long, url long, req long, strength double")
    lines = sinks.overlap_report(found).split("\n")
    assert len(lines) == 152 and lines[2].startswith("| p/149 | q/149 |") and lines[-1].startswith("| p/0 | q/0 |")
    sinks.write_findings(found, str(tmp_path / "findings"))
    got = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "findings")).collect()]
    assert sorted(tuple(x.values()) for x in got) == sorted(rows)


def test_mostly_failed_look_ups_are_refused(spark):
    matches = spark.createDataFrame([(i,) for i in range(11)], "entity long")
    filers = lambda n: spark.createDataFrame([(i, "6770" if i == 0 else "7372") for i in range(n)], "entity long, sic string")
    assert sorted(map(tuple, resolve.drop_shells(matches, filers(10)).collect())) == [(i, "7372") for i in range(1, 10)] + [(10, None)]
    with pytest.raises(ValueError):
        resolve.drop_shells(matches, filers(9))  # two of ten


def test_streams_of_shards_stay_off_the_driver(spark, tmp_path, monkeypatch):
    """A stream is looked for, never read whole by the driver."""

    def refuse(*_):
        raise MemoryError("the driver read a stream")

    monkeypatch.setattr(readers, "read_text", refuse, raising=False)
    for i in range(2):
        (tmp_path / f"shard-{i}.json").write_text('{"schema_version": 2, "status": "complete", "sources": []}')
        (tmp_path / f"shard-{i}.ndjson").write_text('{"key":"k","company":"c","platform":"p"}\n' * (i + 1))
    keys = readers.merge_dir(spark, str(tmp_path), 2)[1]
    assert Counter(r["shard"] for r in keys.collect()) == {0: 1, 1: 2}
    with pytest.raises(ValueError, match="shard 2"):
        readers.merge_dir(spark, str(tmp_path), 3)


@pytest.mark.parametrize("most", [1, 2, 50])
def test_examples_of_common_and_rare_values(spark, most):
    """However many sources hold a value, it is an example of each finding that shares it (F2)."""
    held = {"v1": "abcd", "v2": "ab", "v3": "abc", "v4": "bc", "v5": "abcd", "v6": "d"}
    facts = spark.createDataFrame([("p", k, "req", v) for v, ks in held.items() for k in ks] * 2, "platform string, key string, kind string, value string")
    found = spark.createDataFrame([("p/a", "p/b"), ("p/c", "p/b"), ("p/c", "p/d")], "a string, b string")
    got = {(r["a"], r["b"]): r["examples"] for r in resolve.examples(facts, found, 3, most).collect()}
    assert got == {("p/a", "p/b"): ["v1", "v2", "v3"], ("p/c", "p/b"): ["v1", "v3", "v4"], ("p/c", "p/d"): ["v1", "v5"]}


def test_outcomes_need_no_pairs(spark):
    """Sources times entities of one name are counted, not written out (F1)."""
    ids = spark.range(2_000)
    sources = ids.select(F.lit("p").alias("platform"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit("Plain Name").alias("company"))
    columns = [F.lit("").alias("ticker"), F.array().cast("array<string>").alias("websites")]
    entities = ids.select("id", F.lit("Plain Name, Inc.").alias("name"), *columns)
    rows = resolve.outcomes(sources, entities).collect()
    assert len(rows) == 2_000 and {(r["n"], r["outcome"], r["method"]) for r in rows} == {(2_000, "ambiguous", "exact-name")}
    assert resolve.resolve(sources, entities).count() == 4_000_000


def test_proposals_are_not_shuffled_as_pairs(spark):
    """Nothing is aggregated once sources and entities are paired."""
    plan = QUERIES["j07_proposals"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_proposals_are_not_broadcast(spark):
    """Parts, names and entities grow with the input, so none goes by the driver (F1 of round 3)."""
    found = QUERIES["j07_proposals"](spark, SMALL)
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_entities_of_several_names(spark):
    entities = spark.createDataFrame([(1, "Acme, Inc.", "", None), (1, "Beta Works", "", None), (2, "Acme", "", None), (3, "beta works llc", "", None)], "id long, name string, ticker string, websites array<string>")
    sources = spark.createDataFrame([("p", "x1", "The Beta Works"), ("p", "acme7", "Nobody"), ("p", "x2", "ACME"), ("q", "x2", "ACME")], "platform string, key string, company string")
    got = {(r["platform"], r["key"], r["entity"]): (r["entity_name"], r["method"], r["confidence"]) for r in resolve.proposals(sources, entities).collect()}
    name, key = ("exact-name", "high"), ("exact-key", "medium")
    want = {("p", "x1", 1): ("Beta Works", *name), ("p", "x1", 3): ("beta works llc", *name), ("p", "acme7", 1): ("Acme, Inc.", *key), ("p", "acme7", 2): ("Acme", *key)}
    assert got == want | {(p, "x2", e): (n, *name) for p in "pq" for e, n in ((1, "Acme, Inc."), (2, "Acme"))}
