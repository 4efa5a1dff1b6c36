"""Payloads of boards whose postings need a rule of their own, as postings.

``RULES`` has a function for each platform: from a reader of JSON paths, the source's key
and the clock of the scan it makes the fields that the platform publishes. What the
platforms share (types, schema, records without title or URL) is done once, in ``parse``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, pay, text
from ..functions.vocab import employment_type, workplace_type
from ..schema import COMPENSATION, POSTING

Value = Callable[[str], Column]
NOWHERE = "unknown/remote"
PHENOM_DATES = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd")


def _first(*values: Column) -> Column:
    return F.coalesce(*values)


def _number(x: Column) -> Column:
    return F.try_to_number(F.coalesce(x, F.lit("")), F.lit("999999999999.999999")).cast("double")


def _paid(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """Pay with the ends that are given, null where neither is."""
    a, b = _number(low), _number(high)
    made = F.struct(a.alias("min"), b.alias("max"), F.upper(currency).alias("currency"), pay.period_of(period).alias("period"), F.lit(None).alias("summary"), F.lit("employer").alias("provenance"))
    return F.when((F.coalesce(a, F.lit(0.0)) > 0) | (F.coalesce(b, F.lit(0.0)) > 0), made)


def _sites(parts: Column, last: Column | None = None) -> Column:
    """Distinct places, one after the other."""
    every = parts if last is None else F.concat(parts, F.when(last, F.array(F.lit("Remote"))).otherwise(F.array().cast("array<string>")))
    return F.nullif(F.array_join(F.array_distinct(F.filter(every, lambda x: F.coalesce(x, F.lit("")) != "")), "; "), F.lit(""))


def _epoch(x: Column) -> Column:
    return dates.epoch(F.try_to_number(F.coalesce(x, F.lit("")), F.lit("999999999999")).cast("long"), False)


def workable(v: Value, key: Column, now: Column) -> dict[str, Column]:
    entry = "array<struct<country:string,city:string,region:string,hidden:boolean>>"
    shown = F.filter(F.coalesce(F.from_json(v("$.locations"), entry), F.array().cast(entry)), lambda x: ~F.coalesce(x["hidden"], F.lit(False)))
    place = F.transform(shown, lambda x: F.concat_ws(", ", *[F.nullif(F.trim(x[n]), F.lit("")) for n in ("city", "region", "country")]))
    far = F.coalesce(v("$.telecommuting") == "true", F.lit(False))
    return {
        "url": _first(v("$.url"), F.concat(F.lit("https://apply.workable.com/j/"), v("$.shortcode"))), "title": v("$.title"), "location": _first(_sites(place, far), F.lit("unknown")),
        "remote": F.when(far, True), "workplace_type": F.when(far, "remote"), "posted_at": dates.first_layout(v("$.published_on")), "external_id": v("$.shortcode"),
    }


def bamboohr(v: Value, key: Column, now: Column) -> dict[str, Column]:
    own = F.concat_ws(", ", F.coalesce(v("$.location.city"), F.lit("")), F.coalesce(v("$.location.state"), F.lit("")))
    other = F.concat_ws(", ", v("$.atsLocation.city"), _first(v("$.atsLocation.state"), v("$.atsLocation.province")), v("$.atsLocation.country"))
    far = F.when(F.lower(v("$.isRemote")).isin("true", "1", "yes"), True).when(v("$.isRemote").isNotNull(), False)
    return {
        "url": F.concat(F.lit("https://"), key, F.lit(".bamboohr.com/careers/list?id="), v("$.id")), "title": v("$.jobOpeningName"),
        "location": F.when(own != ", ", own).when(other != "", other).otherwise("remote"), "department": v("$.departmentLabel"), "employment": v("$.employmentStatusLabel"),
        "workplace_type": _first(workplace_type(v("$.locationType")), F.when(far, "remote")), "remote": far, "external_id": v("$.id"),
    }


def jibe(v: Value, key: Column, now: Column) -> dict[str, Column]:
    link = F.concat(F.lit("https://"), key, F.lit("/jobs/"), F.url_encode(v("$.slug")))
    return {
        "url": F.when(v("$.full_location").isNotNull(), _first(link, v("$.apply_url"))), "title": v("$.title"), "location": v("$.full_location"), "department": v("$.department"),
        "employment": v("$.employment_type"), "requisition_id": v("$.req_id"), "external_id": v("$.slug"), "posted_at": dates.first_layout(v("$.posted_date")), "updated_at": dates.first_layout(v("$.update_date")),
        "compensation": _paid(v("$.salary_min_value"), v("$.salary_max_value"), v("$.salary_currency"), v("$.salary_frequency")),
    }


def teamtailor(v: Value, key: Column, now: Column) -> dict[str, Column]:
    job, salary = "$._jobposting", "$._jobposting.baseSalary"
    far = F.coalesce(workplace_type(v(f"{job}.jobLocationType")) == "remote", F.lit(False))
    place = "array<struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>>"
    found = F.transform(F.coalesce(F.from_json(v(f"{job}.jobLocation"), place), F.array().cast(place)), lambda x: F.concat_ws(", ", *[F.nullif(F.trim(x["address"][n]), F.lit("")) for n in ("addressLocality", "addressRegion", "addressCountry")]))
    low, high, one = (v(f"{salary}.value.{n}") for n in ("minValue", "maxValue", "value"))
    tail = F.nullif(F.regexp_extract(F.coalesce(v("$.url"), F.lit("")), r"/jobs/([^-]*)", 1), F.lit(""))
    return {
        "url": F.when(F.startswith(v("$.url"), F.lit("https://")), v("$.url")), "title": v("$.title"), "location": _first(_sites(found), F.when(far, "remote"), F.lit("unknown")),
        "department": v(f"{job}.occupationalCategory"), "employment": v(f"{job}.employmentType"), "remote": F.when(far, True), "workplace_type": F.when(far, "remote"),
        "posted_at": dates.first_layout(_first(v("$.date_published"), v(f"{job}.datePosted"))), "updated_at": dates.first_layout(v("$.date_modified")),
        "external_id": _first(v(f"{job}.identifier.value"), tail, v("$.id")), "compensation": _paid(_first(low, one), _first(high, one), v(f"{salary}.currency"), v(f"{salary}.value.unitText")),
    }


def personio(v: Value, key: Column, now: Column) -> dict[str, Column]:
    """Positions of the XML feed, each as JSON with the feed's names."""
    offices = F.concat(F.array(v("$.office")), F.coalesce(F.from_json(v("$.additionalOffices"), "array<string>"), F.array().cast("array<string>")))
    team = v("$.recruitingCategory")
    return {
        "url": F.concat(F.lit("https://"), key, F.lit(".jobs.personio.de/job/"), v("$.id")), "title": F.when(v("$.id").isNotNull(), v("$.name")), "location": _first(_sites(F.transform(offices, lambda x: F.trim(x))), F.lit("unknown")),
        "department": v("$.department"), "team": F.when(F.lower(team) != F.lower(F.coalesce(v("$.department"), F.lit(""))), team), "employment_type": text.two_field_employment(v("$.employmentType"), v("$.schedule")),
        "seniority": v("$.seniority"), "posted_at": dates.first_layout(v("$.createdAt")), "external_id": v("$.id"),
        "compensation": _paid(v("$.salaryInformation.min"), v("$.salaryInformation.max"), v("$.salaryInformation.currencyCode"), v("$.salaryInformation.type")),
    }


def workday(v: Value, key: Column, now: Column) -> dict[str, Column]:
    bullets = F.coalesce(F.from_json(v("$.bulletFields"), "array<string>"), F.array().cast("array<string>"))
    return {
        "url": F.concat(key, v("$.externalPath")), "title": v("$.title"), "location": _first(v("$.locationsText"), F.lit("unknown")), "employment_type": text.unlabelled_employment(bullets),
        "requisition_id": text.requisition(bullets), "posted_at": dates.relative(v("$.postedOn"), now),
    }


def oraclecloud(v: Value, key: Column, now: Column) -> dict[str, Column]:
    """``key`` is host,site."""
    host, site = F.split_part(key, F.lit(","), F.lit(1)), F.split_part(key, F.lit(","), F.lit(2))
    return {
        "url": F.concat(F.lit("https://"), host, F.lit("/hcmUI/CandidateExperience/en/sites/"), site, F.lit("/job/"), v("$.Id")), "title": v("$.Title"), "location": _first(v("$.PrimaryLocation"), F.lit(NOWHERE)),
        "department": _first(v("$.Department"), v("$.JobFunction"), v("$.JobFamily")), "employment": _first(v("$.JobSchedule"), v("$.JobType")), "workplace_type": workplace_type(_first(v("$.WorkplaceTypeCode"), v("$.WorkplaceType"))),
        "posted_at": dates.first_layout(v("$.PostedDate")), "external_id": v("$.Id"),
    }


def phenom(v: Value, key: Column, now: Column) -> dict[str, Column]:
    return {
        "url": _first(F.concat(F.lit("https://"), key, F.lit("/us/en/job/"), v("$.jobId")), v("$.applyUrl")), "title": v("$.title"), "location": _first(v("$.cityState"), v("$.location"), F.lit(NOWHERE)),
        "department": v("$.category"), "employment": v("$.type"), "posted_at": dates.first_layout(v("$.postedDate"), PHENOM_DATES), "external_id": v("$.jobId"),
    }


def eightfold(v: Value, key: Column, now: Column) -> dict[str, Column]:
    work, number = workplace_type(v("$.work_location_option")), F.when(v("$.id") != "0", v("$.id"))
    return {
        "url": _first(v("$.canonicalPositionUrl"), F.concat(F.lit("https://"), key, F.lit(".eightfold.ai/careers/job/"), v("$.id"))), "title": v("$.name"), "location": _first(v("$.location"), F.lit(NOWHERE)),
        "department": v("$.department"), "team": v("$.business_unit"), "workplace_type": work, "remote": F.when(work == "remote", True), "posted_at": _epoch(v("$.t_create")),
        "updated_at": _epoch(v("$.t_update")), "requisition_id": v("$.display_job_id"), "external_id": number,
    }


def rippling(v: Value, key: Column, now: Column) -> dict[str, Column]:
    entry = "array<struct<name:string,country:string,state:string,city:string,workplaceType:string>>"
    sites = F.coalesce(F.from_json(v("$.locations"), entry), F.array().cast(entry))
    far = lambda x: F.when(x["workplaceType"] == "REMOTE", "Remote")
    place = F.transform(sites, lambda x: _first(F.nullif(x["name"], F.lit("")), F.concat_ws(", ", *[F.nullif(x[n], F.lit("")) for n in ("city", "state", "country")], far(x))))
    kinds = F.array_distinct(F.filter(F.transform(sites, lambda x: workplace_type(x["workplaceType"])), lambda x: x.isNotNull()))
    work = F.when(F.size(kinds) == 1, F.try_element_at(kinds, F.lit(1)))  # sites that differ tell nothing
    return {
        "url": v("$.url"), "title": v("$.name"), "location": _first(_sites(place), F.lit("")), "department": v("$.department.name"), "workplace_type": work,
        "remote": F.when(work == "remote", True), "external_id": v("$.id"),
    }


def gem(v: Value, key: Column, now: Column) -> dict[str, Column]:
    entry = "array<struct<name:string,city:string,isoCountry:string,isRemote:boolean>>"
    sites = F.coalesce(F.from_json(v("$.locations"), entry), F.array().cast(entry))
    one = F.try_element_at(sites, F.lit(1))
    all_far = (F.size(sites) > 0) & F.forall(sites, lambda x: F.coalesce(x["isRemote"], F.lit(False)))
    work = _first(workplace_type(v("$.job.locationType")), F.when(all_far, "remote"))
    return {
        "url": F.concat(F.lit("https://jobs.gem.com/"), key, F.lit("/"), _first(v("$.extId"), v("$.id"))), "title": v("$.title"),
        "location": F.concat_ws(", ", *[F.nullif(F.trim(one[n]), F.lit("")) for n in ("name", "city", "isoCountry")]), "department": v("$.job.department.name"), "employment": v("$.job.employmentType"),
        "requisition_id": v("$.job.requisitionId"), "external_id": v("$.extId"), "workplace_type": work, "remote": F.when(work == "remote", True), "posted_at": _epoch(v("$.firstPublishedTsSec")),
    }


def amazon(v: Value, key: Column, now: Column) -> dict[str, Column]:
    day = F.regexp_replace(v("$.posted_date"), r"\s+", " ")
    return {
        "url": F.concat(F.lit("https://www.amazon.jobs"), v("$.job_path")), "title": v("$.title"), "location": _first(v("$.normalized_location"), v("$.location"), F.lit("unknown")),
        "department": v("$.job_category"), "team": v("$.job_family"), "employment": v("$.job_schedule_type"), "posted_at": dates.first_layout(day), "external_id": v("$.id_icims"),
    }


RULES = {f.__name__: f for f in (workable, bamboohr, jibe, teamtailor, personio, workday, oraclecloud, phenom, eightfold, rippling, gem, amazon)}


def parse(records: DataFrame, platform: str, now: Column | None = None) -> DataFrame:
    """Postings of one platform in the engine's schema, with _seq; ``now`` is the clock of the scan."""
    path = lambda p: F.nullif(F.trim(F.get_json_object("record", p)), F.lit(""))
    made = RULES[platform](path, F.col("key"), F.current_timestamp() if now is None else now)
    if "employment" in made:
        made["employment_type"] = employment_type(made.pop("employment"))
    made |= {"company": F.col("key"), "source": F.struct("platform", "key")}
    kinds = {f.name: f.dataType for f in POSTING.fields}
    fields = [made.get(n, F.lit(None)).cast(COMPENSATION if n == "compensation" else t).alias(n) for n, t in kinds.items()]
    rows = records.filter(F.col("platform") == platform).select(*fields, "_seq")
    return rows.filter("coalesce(title, '') <> '' AND coalesce(url, '') <> ''")
