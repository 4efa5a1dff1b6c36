"""Every registered query with SQL equals it on the smallest tables; predicates equal a plain matcher."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest

from vacanta.functions.vocab import REMOTE_TERMS
from vacanta.plans.query import FIELDS, EmployerFilter, Query, check_scope
from vacanta.registry import QUERIES, SQL
from vacanta.schema import POSTINGS

DATA = "/root/testdata/sf0.001"
NOW = datetime(2026, 7, 29, 12, tzinfo=timezone.utc)
#: Whole folds take long; their own tests are in test_corpus.
SLOW: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for n in os.listdir(DATA):
        con.sql(f"create view {n.removesuffix('.parquet')} as select * from '{DATA}/{n}'")
    return con


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def match(q: Query, r: dict) -> bool:
    """The vocabulary in plain Python."""
    low = lambda x: (r[x] or "").lower()
    has = lambda x, ts: not (ts := [t.strip().lower() for t in ts if t.strip()]) or any(t in low(x) for t in ts)
    heuristic = any(t in low(x) for t in REMOTE_TERMS for x in ("location", "title"))
    remote = r["remote"] if r["remote"] is not None else heuristic
    pay = r["compensation"]
    top = max(pay["min"] or 0, pay["max"] or 0) if pay else 0
    period = (pay or {}).get("period") or ("hour" if 0 < top <= 250 else "year")
    annual = top * {"hour": 2080, "day": 260, "week": 52, "month": 12, "year": 1}.get(period, 0) if top > 0 else None
    kinds = [t for t in q.employment_types if t.strip()]
    places = [t for t in q.workplace_types if t.strip()]
    hybrid = "hybrid" in low("location") or "hybrid" in low("title")
    at_place = not places or (r["workplace_type"] in places if r["workplace_type"] else ("remote" in places and remote) or ("hybrid" in places and hybrid))
    dep = [t.strip().lower() for t in q.departments if t.strip()]
    excluded = [t.strip().lower() for t in q.exclude_titles if t.strip()]
    return bool(
        (not q.remote or remote)
        and (not q.has_compensation or (pay and (pay["min"] or pay["max"] or pay["summary"])))
        and (q.min_annual <= 0 or (annual is not None and annual >= q.min_annual))
        and has("title", q.titles)
        and has("location", q.locations)
        and has("company", q.companies)
        and not any(t in low("title") for t in excluded)
        and (not dep or any(t in low("department") or t in low("team") for t in dep))
        and (not kinds or r["employment_type"] in kinds)
        and at_place
        and (q.posted_since is None or (r["posted_at"] is not None and r["posted_at"] >= q.posted_since))
    )


BATTERY = [
    Query(), Query(remote=True), Query(has_compensation=True), Query(min_annual=150000), Query(titles=("ENGINEER",)), Query(titles=("  engineer  ", "")),
    Query(titles=("", "   ")), Query(exclude_titles=("Manager",)), Query(locations=("remote", "berlin")), Query(companies=("ACME",)), Query(departments=("engineering",)),
    Query(employment_types=("contract",)), Query(employment_types=("",)), Query(workplace_types=("remote",)), Query(workplace_types=("hybrid",)), Query(workplace_types=("onsite",)),
    Query(posted_since=NOW - timedelta(hours=72)),
    Query(remote=True, has_compensation=True, min_annual=1000, titles=("engineer",), exclude_titles=("staff",), locations=("remote",), companies=("acme",)),
]


@pytest.fixture(scope="module")
def random_rows():
    rng, rows = random.Random(7), []
    for i in range(400):
        pay = None if rng.random() < 0.3 else {"min": rng.choice([None, 0.0, 20.0, 90000.0]), "max": rng.choice([None, 0.0, 30.0, 160000.0]), "currency": "USD", "period": rng.choice([None, "", "hour", "month", "year"]), "summary": rng.choice(["", "Competitive", None]), "provenance": "employer"}
        rows.append({
            "company": rng.choice(["Acme", "Globex", "ACME Labs"]), "url": f"u{i}", "title": rng.choice(["Senior Software Engineer", "Staff Engineer", "Marketing Manager", "Hybrid Chef", "Virtual Aide"]),
            "location": rng.choice(["Remote", "Berlin, Germany (Hybrid)", "London", "", "Anywhere"]), "compensation": pay, "remote": rng.choice([None, True, False]), "department": rng.choice([None, "", "Engineering", "Sales"]),
            "team": rng.choice([None, "Platform Engineering", ""]), "employment_type": rng.choice([None, "", "contract", "full_time"]), "workplace_type": rng.choice([None, "", "remote", "hybrid", "onsite"]), "seniority": None,
            "posted_at": rng.choice([None, NOW - timedelta(hours=rng.randint(1, 200))]), "updated_at": NOW, "requisition_id": None, "external_id": str(i), "source": {"platform": "p", "key": "k"}, "_seq": i,
        })
    return rows


@pytest.mark.parametrize("i", range(len(BATTERY)))
def test_condition_equals_match(spark, random_rows, i):
    df = spark.createDataFrame(random_rows, POSTINGS)
    got = sorted(r["_seq"] for r in BATTERY[i].apply(df).select("_seq").collect())
    assert got == [r["_seq"] for r in random_rows if match(BATTERY[i], r)]


def test_every_field_counts():
    sample = {"remote": True, "has_compensation": True, "min_annual": 1.0, "posted_since": NOW}
    for name in FIELDS:
        assert not Query(**{name: sample.get(name, ("x",))}).is_zero(), name
    assert Query(titles=("", " ")).is_zero() and EmployerFilter().is_zero() and not EmployerFilter(private=True).is_zero()


def test_scope(spark):
    sources = spark.createDataFrame([("p", "acme", "Acme"), ("p", "globex", "Globex")], "platform string, key string, company string")
    assert [r["key"] for r in check_scope(sources, ["ACM"]).collect()] == ["acme"]
    for bad in ([], ["zzz"]):
        with pytest.raises(ValueError):
            check_scope(sources, bad)
    with pytest.raises(ValueError):
        check_scope(sources, ["e"], most=1)
