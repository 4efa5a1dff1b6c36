"""Payloads of job boards as postings: one table of JSON paths, one set of rules.

``records`` are those of ``sources.fixture.scan``: platform, key, record (JSON of one job)
and _seq. Paths are read with built-ins; pay in prose is read only where no structured
pay is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, pay
from ..functions.paytext import description_pay_udf
from ..functions.text import location, scalar
from ..functions.vocab import employment_type, workplace_type
from ..schema import COMPENSATION

#: Where each platform's feed has a posting's fields. ``place`` lists the
#: parts of a location, ``flag`` a Boolean for remote work, ``body`` the description.
PATHS = {
    "greenhouse": {"url": "$.absolute_url", "title": "$.title", "place": ["$.location.name"], "posted_at": "$.first_published", "updated_at": "$.updated_at", "requisition_id": "$.requisition_id", "external_id": "$.id"},
    "lever": {"url": "$.hostedUrl", "title": "$.text", "place": ["$.categories.location"], "department": "$.categories.department", "team": "$.categories.team", "seniority": "$.categories.level", "employment": "$.categories.commitment", "workplace": "$.workplaceType", "created_ms": "$.createdAt", "external_id": "$.id", "min": "$.salaryRange.min", "max": "$.salaryRange.max", "currency": "$.salaryRange.currency", "interval": "$.salaryRange.interval", "body": "$.descriptionPlain"},
    "ashby": {"url": "$.jobUrl", "title": "$.title", "place": ["$.location"], "department": "$.department", "team": "$.team", "employment": "$.employmentType", "workplace": "$.workplaceType", "flag": "$.isRemote", "posted_at": "$.publishedAt", "external_id": "$.id", "summary": "$.compensation.compensationTierSummary", "body": "$.descriptionPlain"},
    "smartrecruiters": {"title": "$.name", "place": ["$.location.city", "$.location.region", "$.location.country"], "department": "$.department.label", "seniority": "$.experienceLevel.label", "employment": "$.typeOfEmployment.label", "posted_at": "$.releasedDate", "requisition_id": "$.refNumber", "external_id": "$.id"},
    "recruitee": {"url": "$.careers_url", "title": "$.title", "place": ["$.location"], "department": "$.department", "seniority": "$.experience_code", "employment": "$.employment_type_code", "posted_at": "$.published_at", "updated_at": "$.updated_at", "external_id": "$.id", "min": "$.salary.min", "max": "$.salary.max", "currency": "$.salary.currency", "interval": "$.salary.period"},
    "pinpoint": {"url": "$.url", "title": "$.title", "place": ["$.location.city", "$.location.province"], "department": "$.job.department.name", "employment": "$.employment_type_text", "workplace": "$.workplace_type", "external_id": "$.id", "min": "$.compensation_minimum", "max": "$.compensation_maximum", "currency": "$.compensation_currency", "interval": "$.compensation_frequency", "shown": "$.compensation_visible"},
    "breezy": {"url": "$.url", "title": "$.name", "place": ["$.location.city", "$.location.country.name"], "department": "$.department.name", "employment": "$.type.name", "flag": "$.location.is_remote", "posted_at": "$.published_date", "external_id": "$.id"},
}
#: Platforms whose flag says remote or nothing; elsewhere false is an answer as well.
ONE_WAY = frozenset({"breezy"})
#: The text of a posting without a location.
NOWHERE = {"greenhouse": "unknown/remote", "lever": "unknown/remote"}


def _number(x: Column) -> Column:
    return F.try_to_number(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^0-9.]", ""), F.lit("999999999999.999999")).cast("double")


def parse(records: DataFrame, platform: str) -> DataFrame:
    """Postings of one platform in the engine's schema, with _seq; records without a title
    or a URL are dropped."""
    at = PATHS[platform]
    r = F.col("record")
    raw = lambda f: scalar(r, at[f]) if f in at else F.lit(None).cast("string")
    clean = lambda f: F.nullif(F.trim(raw(f)), F.lit(""))
    work, flag = workplace_type(raw("workplace")), F.lower(raw("flag")) == "true"
    work = F.coalesce(work, F.when(flag, "remote")) if "flag" in at else work
    remote = F.when(work.isNotNull(), work == "remote")
    if "flag" in at:
        remote = F.when(flag, True) if platform in ONE_WAY else flag
    url = F.replace(F.trim(raw("url")), F.lit("http://"), F.lit("https://")) if "url" in at else F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("key"), F.lit("/"), raw("external_id"))
    given = pay.build(_number(raw("min")), _number(raw("max")), raw("currency"), raw("interval"), raw("summary"), "employer").cast(COMPENSATION)
    if "shown" in at:
        given = F.when(F.lower(raw("shown")) == "true", given)
    if "body" in at:
        prose = description_pay_udf(F.coalesce(raw("body"), F.lit("")))
        given = F.coalesce(given, F.when(prose["max"].isNotNull(), prose))
    stamp = dates.first_layout(raw("posted_at")) if "posted_at" in at else dates.epoch(F.try_to_number(raw("created_ms"), F.lit("99999999999999")).cast("long"), True)
    rows = records.filter(F.col("platform") == platform).select(
        F.col("key").alias("company"),
        url.alias("url"),
        F.coalesce(clean("title"), F.lit("")).alias("title"),
        location(F.array(*[F.coalesce(scalar(r, p), F.lit("")) for p in at["place"]]), default=NOWHERE.get(platform, "unknown")).alias("location"),
        given.alias("compensation"),
        remote.alias("remote"),
        clean("department").alias("department"),
        clean("team").alias("team"),
        employment_type(raw("employment")).alias("employment_type"),
        work.alias("workplace_type"),
        clean("seniority").alias("seniority"),
        stamp.alias("posted_at"),
        dates.first_layout(raw("updated_at")).alias("updated_at"),
        clean("requisition_id").alias("requisition_id"),
        F.when(clean("external_id") != "0", clean("external_id")).alias("external_id"),
        F.struct("platform", "key").alias("source"),
        "_seq",
    )
    return rows.filter("title <> '' AND coalesce(url, '') <> ''")


def parse_all(records: DataFrame) -> DataFrame:
    """Every known platform's postings."""
    frames = [parse(records, p) for p in PATHS]
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out
