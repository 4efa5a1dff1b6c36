"""Payloads of platforms become postings."""

import json

from pyspark.sql import functions as F

from vacanta.schema import POSTINGS
from vacanta.sources.platforms import parse_all

RECORDS = [
    ("greenhouse", "acme", {"absolute_url": "http://b.io/1", "title": " Engineer ", "location": {"name": ""}, "first_published": "2026-07-01T09:00:00-04:00", "id": 7}),
    ("lever", "globex", {"hostedUrl": "https://l.co/2", "text": "Chef", "categories": {"location": "Remote, US", "commitment": "Full-time", "team": "Kitchen"}, "workplaceType": "hybrid", "createdAt": 1753000000000, "id": "x", "salaryRange": {"min": 20, "max": 30, "currency": "USD", "interval": "per-hour-wage"}}),
    ("ashby", "initech", {"jobUrl": "https://a.hq/3", "title": "Aide", "location": "Oslo", "isRemote": True, "publishedAt": "2026-07-02T16:21:55.393+00:00", "descriptionPlain": "The salary range is $100,000 - $120,000 per year."}),
    ("smartrecruiters", "umbra", {"id": "9", "name": "Clerk", "location": {"city": "Paris", "region": "", "country": "fr"}, "typeOfEmployment": {"label": "Part-time"}}),
    ("pinpoint", "hooli", {"url": "https://p.io/4", "title": "Host", "id": 4, "location": {"city": "Leeds"}, "compensation_visible": False, "compensation_minimum": 1000}),
    ("breezy", "soylent", {"url": "https://z.hr/5", "name": "Cook", "location": {"is_remote": False}}),
    ("recruitee", "void", {"title": "No link"}),
]


def test_platforms(spark):
    rows = spark.createDataFrame([(p, k, json.dumps(r), i) for i, (p, k, r) in enumerate(RECORDS)], "platform string, key string, record string, _seq long")
    out = parse_all(rows)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in POSTINGS]
    got = {r["company"]: r for r in out.withColumn("at", F.col("posted_at").cast("string")).collect()}
    assert set(got) == {"acme", "globex", "initech", "umbra", "hooli", "soylent"}
    a, g, i, u = (got[x] for x in ("acme", "globex", "initech", "umbra"))
    assert (a["url"], a["title"], a["location"], a["at"], a["external_id"], a["remote"]) == ("https://b.io/1", "Engineer", "unknown/remote", "2026-07-01 13:00:00", "7", None)
    assert (g["employment_type"], g["workplace_type"], g["remote"], g["compensation"]["period"], g["compensation"]["max"]) == ("full_time", "hybrid", False, "hour", 30.0)
    assert (i["remote"], i["workplace_type"], i["compensation"]["provenance"], i["compensation"]["min"]) == (True, "remote", "description", 100000.0)
    assert (u["url"], u["location"], u["employment_type"]) == ("https://jobs.smartrecruiters.com/umbra/9", "Paris, fr", "part_time")
    assert got["hooli"]["compensation"] is None and got["soylent"]["remote"] is None and got["soylent"]["location"] == "unknown"
