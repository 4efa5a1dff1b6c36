"""Vocabulary, pay, names, URLs, dates, ages."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from vacanta.functions import dates, names, pay, text, urls, vocab
from vacanta.functions.paytext import from_description, from_salary, from_text
from vacanta.plans.query import parse_age, parse_enums, parse_posted_since, tool_recency

NOW = datetime(2026, 7, 29, 12, tzinfo=timezone.utc)


def values(spark, column, cells, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_employment_type(spark):
    cells = ["Full-Time", "FULL_TIME", "ft", "Part time", "Intern (Summer 2026)", "Regular", "OTHER", "", None, "Contractor", "temp", "template", "full_time"]
    want = ["full_time", "full_time", "full_time", "part_time", "internship", None, None, None, None, "contract", "temporary", None, "full_time"]
    assert values(spark, vocab.employment_type(F.col("x")), cells) == want


def test_workplace_type(spark):
    cells = ["Hybrid Remote", "Remote/Hybrid", "Office - Remote optional", "On-site", "In Office", "WFH", "moon", None]
    assert values(spark, vocab.workplace_type(F.col("x")), cells) == ["hybrid", "hybrid", "remote", "onsite", "onsite", "remote", None, None]


@pytest.mark.parametrize(
    "low,high,period,want",
    [(160000.0, 185000.0, "year", 185000.0), (13.66, 19.16, "hour", 19.16 * 2080), (None, 5000.0, "month", 60000.0), (18.0, 24.0, None, 24.0 * 2080), (120000.0, 150000.0, None, 150000.0), (90000.0, None, "year", 90000.0), (None, None, None, None), (5.0, 6.0, "fortnight", 0.0)],
)
def test_annual_max(spark, low, high, period, want):
    df = spark.createDataFrame([(low, high, period)], "a double, b double, p string")
    assert df.select(pay.annual_max(F.col("a"), F.col("b"), F.col("p"))).first()[0] == want


def test_pay_label(spark):
    df = spark.createDataFrame([(1000.0, 2000.5, "USD", "month", ""), (5.0, 5.0, "", "", ""), (0.0, 0.0, "", "", "Competitive")], "a double, b double, c string, p string, s string")
    assert [r[0] for r in df.select(pay.label(*[F.col(x) for x in "abcps"])).collect()] == ["USD 1000-2000.5/month", "5", "Competitive"]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("The salary range for this position is $150,000 - $200,000 per year.", (150000, 200000, "year", "USD")),
        ("The hourly rate for this role is $22.50 to $28.00 per hour.", (22.5, 28, "hour", "USD")),
        ("Base pay range: $180K–$220K", (180000, 220000, "", "USD")),
        ("<p>Salary: $120,000 &ndash; $145,000</p>", (120000, 145000, "", "USD")),
        ("salary up to $200,000", (0, 200000, "", "USD")),
        ("İ" * 70 + " salary $150,000-$200,000 per year", (150000, 200000, "year", "USD")),
        ("salary C$95,000 - C$120,000", (95000, 120000, "", "CAD")),
    ],
)
def test_pay_from_text(raw, want):
    got = from_text(raw)
    assert (got["min"], got["max"], got["period"], got["currency"]) == want


@pytest.mark.parametrize("raw", ["", None, "no money here", "we raised $50,000,000 in funding", "401(k) match up to $5,000", "costs $150,000 - $200,000", "salary C$95,000 - A$120,000", "salary $30,000 - $9,000,000"])
def test_pay_refused(raw):
    assert from_text(raw) is None


def test_pay_from_markup():
    got = from_description('<div class="x pay-range"><span>$145,700</span>&mdash;<span>$200,300 USD</span></div>')
    assert (got["min"], got["max"], got["provenance"]) == (145700, 200300, "structured")
    assert from_description('<div class="pay-range-note">$145,700</div>') is None
    assert from_salary("$30 / hour")["period"] == "hour"


@pytest.mark.parametrize(
    "raw,want",
    [
        ("HTTPS://Example.COM/Jobs/1/?utm_source=x&b=2&a=1#top", "https://example.com/Jobs/1?a=1&b=2"),
        ("https://example.com/", "https://example.com/"),
        ("https://example.com/a?x=2&x=1&gh_jid=5", "https://example.com/a?x=2&x=1"),
        ("https://example.com/a?sourceId=1&reference=2", "https://example.com/a?reference=2&sourceId=1"),
        ("://not a url", "://not a url"),
        ("  ", ""),
        ("https://example.com/a?q=a b", "https://example.com/a?q=a+b"),
    ],
)
def test_normalize_url(raw, want):
    assert urls.normalize_url(raw) == want


@pytest.mark.parametrize("raw,want", [("https://X.com/en-us/job/1/apply", "https://x.com/job/1"), ("https://x.com/careers/1?gh_jid=7", "https://x.com/careers/1?gh_jid=7"), ("nohost", ""), ("https://x.com/en", "https://x.com/")])
def test_sweep_url(raw, want):
    assert urls.sweep_url(raw) == want


def test_names(spark):
    cells = ["AT&T Inc.", "The Company", "Acme Holdings Group Ltd", "Palo Alto Networks, Inc."]
    assert values(spark, names.normalize(F.col("x")), cells) == ["at and t", "the company", "acme", "palo alto networks"]
    assert values(spark, names.trim_digits(F.col("x")), ["acme12", "ab1", "acme", "123"]) == ["acme", None, None, None]
    assert values(spark, names.distinctive(F.col("x")), ["abc", "abcde", "a b"]) == [False, True, True]
    assert values(spark, F.array_join(names.host_labels(F.col("x")), "+"), ["https://www.at-t.com:80/x", "jobs.acme.io"]) == ["att", "acme"]


def test_dates(spark):
    got = values(spark, dates.relative(F.col("x"), F.lit(NOW)).cast("date").cast("string"), ["Posted Today", "Posted Yesterday", "Posted 3 Days Ago", "Posted 30+ Days Ago", None])
    assert got == ["2026-07-29", "2026-07-28", "2026-07-26", None, None]
    df = spark.createDataFrame([("a", "13/01/2026"), ("a", "02/03/2026"), ("b", "01/13/2026"), ("b", "02/03/2026"), ("c", "02/03/2026"), ("d", None)], "s string, x string")
    got = {(r["s"], r["x"]): str(r["parsed"]) for r in dates.slash_dates(df, ["s"], "x").collect()}
    assert got[("a", "02/03/2026")] == "2026-03-02" and got[("b", "02/03/2026")] == "2026-02-03" and got[("c", "02/03/2026")] == "None"


def test_ages():
    assert parse_age("3d") == timedelta(days=3) and parse_age("1.5w") == timedelta(days=10.5) and parse_age("1h30m") == timedelta(minutes=90)
    assert parse_posted_since("", NOW) is None and parse_posted_since("72h", NOW) == NOW - timedelta(hours=72)
    for bad in ("0d", "-2h", "soon", "2026-07-01T00:00:00"):
        with pytest.raises(ValueError):
            parse_posted_since(bad, NOW)
    with pytest.raises(ValueError):
        tool_recency("2026-07-01", 3, NOW)
    assert parse_enums(["FULL-TIME", " "], "employment") == ("full_time",)
    with pytest.raises(ValueError):
        parse_enums(["FULL-TIME"], "employment", spellings=False)


def test_payload_fields(spark):
    df = spark.createDataFrame([("Sales, Full Time, Berlin",), ("Remote",)], "x string")
    got = [tuple(r[0]) for r in df.select(text.details(F.col("x"))).collect()]
    assert got == [("Sales", "full_time", None, "Berlin"), (None, None, "remote", "Remote")]
    df = spark.createDataFrame([(["Posted", "R-1234", "x y 1"],)], "x array<string>")
    assert df.select(text.requisition(F.col("x"))).first()[0] == "R-1234"
    df = spark.createDataFrame([("13/2",)], "x string")
    assert df.select(text.location(F.array(F.lit(" a "), F.lit(""), F.lit("a"), F.lit("b")))).first()[0] == "a, b"


def test_url_identity_equals_the_plain_form(spark):
    rng = random.Random(3)
    parts = {
        "scheme": ["https://", "HTTP://", "ftp+x://", "", "mailto:"], "host": ["Jobs.Example.com", "a.b:8080", "x:99999", "user@h.org", "ü.de", "h"],
        "path": ["", "/", "//", "/a/b/", "/A%20b", "/é", "/a b", "/a;v=1/"], "query": ["", "?", "?b=2&a=1", "?utm_x=1", "?utm_x=1&a=", "?a", "?a=1=2", "?ref=x&z=9&Z=8", "?q=a+b&q=0", "?a=%zz", "?a=1;b=2", "?a=*"],
        "end": ["", "#f", "#f g", "#%zz"],
    }
    found = ["".join(rng.choice(v) for v in parts.values()) for _ in range(1500)] + ["", " https://x.org/a ", "https://x.org/a\n", None]
    rows = spark.createDataFrame([(u,) for u in found], "url string").select("url", urls.url_identity(F.col("url")).alias("form")).collect()
    assert [r["form"] for r in rows] == [urls.normalize_url(r["url"]) if r["url"] is not None else "" for r in rows]
