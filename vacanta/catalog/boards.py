"""Payloads of nineteen platforms, written from the part table as its board would, and read as postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import payloads, platforms
from .more import _table
from .queries import instant, register

def _s(*columns, **named):
    return F.struct(*columns, *[(c if not isinstance(c, str) else F.lit(c)).alias(n) for n, c in named.items()])


def payload(platform: str):
    """What a board says of a part, as a struct."""
    number, even = F.col("p_partkey").cast("string"), F.col("p_partkey") % 2 == 0
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd")
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    city = F.when(even, "Oslo").otherwise("")
    found = {
        "workable": _s(title=name, shortcode=number, telecommuting=even, published_on=day, locations=F.array(_s(city="Oslo", region="", country="Norway", hidden=F.lit(False)), _s(city="Rome", region="", country="Italy", hidden=even))),
        "bamboohr": _s(id=number, jobOpeningName=name, departmentLabel=brand, employmentStatusLabel="Full-Time", location=_s(city=city, state=F.when(even, "NO").otherwise("")), atsLocation=_s(province="Lazio", country="Italy"), isRemote=even),
        "jibe": _s(title=name, slug=number, full_location="Oslo, Norway", department=brand, employment_type="Contractor", req_id=F.concat(F.lit("R"), number), posted_date=day, salary_min_value=F.col("p_size"), salary_currency="usd", salary_frequency="HOUR"),
        "teamtailor": _s(id="x", url=F.concat(F.lit("https://t.co/jobs/"), number, F.lit("-a")), title=name, date_published=F.concat(day, F.lit("T08:00:00Z")), _jobposting=_s(occupationalCategory=brand, jobLocationType=F.when(even, "TELECOMMUTE remote").otherwise(""), jobLocation=F.array(_s(address=_s(addressLocality="Oslo", addressCountry="NO"))))),
        "personio": _s(id=number, name=name, office="Berlin", additionalOffices=F.array(F.lit("Berlin"), F.lit("Bonn")), department=brand, recruitingCategory=F.when(even, brand).otherwise(kind), employmentType="permanent", schedule=F.when(even, "part-time").otherwise("full-or-part-time"), createdAt=F.concat(day, F.lit("T08:00:00+02:00"))),
        "workday": _s(title=name, externalPath=F.concat(F.lit("/job/"), number), locationsText=city, postedOn=F.when(even, "Posted Yesterday").otherwise("Posted 3 Days Ago"), bulletFields=F.array(F.lit("Part time"), F.concat(F.lit("JR-"), number))),
        "oraclecloud": _s(Id=number, Title=name, PrimaryLocation=city, PostedDate=day, JobFunction=brand, JobSchedule=F.when(even, "Full time").otherwise(""), JobType="Intern", WorkplaceTypeCode="ORA_HYBRID"),
        "phenom": _s(title=name, cityState=city, location="Rome", jobId=F.when(even, number).otherwise(""), applyUrl=F.concat(F.lit("https://a.co/"), number), postedDate=day, type="Full time", category=brand),
        "eightfold": _s(id=F.col("p_partkey"), name=name, location="", department=brand, business_unit=kind, t_create=F.unix_timestamp(day, "yyyy-MM-dd"), work_location_option=F.when(even, "remote_local").otherwise("onsite"), display_job_id=F.concat(F.lit("D"), number)),
        "rippling": _s(id=number, name=name, url=F.concat(F.lit("https://r.co/"), number), department=_s(name=brand), locations=F.array(_s(name="Oslo", city="", country="", workplaceType=F.when(even, "HYBRID").otherwise("HYBRID")), _s(name="", city="Rome", country="Italy", workplaceType=F.when(even, "REMOTE").otherwise("HYBRID")))),
        "gem": _s(id="g", extId=number, title=name, firstPublishedTsSec=F.unix_timestamp(day, "yyyy-MM-dd"), locations=F.array(_s(name="Oslo", city="", isoCountry="NOR", isRemote=even)), job=_s(department=_s(name=brand), employmentType="full_time", locationType="")),
        "amazon": _s(id_icims=number, title=name, job_path=F.concat(F.lit("/en/jobs/"), number), normalized_location=city, location="IT, Rome", job_category=brand, job_family=kind, job_schedule_type="Full-Time", posted_date=F.date_format(day.cast("date"), "MMMM  d, yyyy")),
        "greenhouse": _s(absolute_url=F.concat(F.lit("http://g.io/"), number), title=name, location=_s(name=city), first_published=F.concat(day, F.lit("T08:00:00+00:00")), id=F.col("p_partkey")),
        "lever": _s(hostedUrl=F.concat(F.lit("https://l.co/"), number), text=name, categories=_s(location=city, commitment="Full-time", team=kind, department=brand), workplaceType=F.when(even, "hybrid").otherwise("onsite"), createdAt=F.unix_timestamp(day, "yyyy-MM-dd") * 1000, id=number),
        "ashby": _s(jobUrl=F.concat(F.lit("https://a.hq/"), number), title=name, location="Oslo", department=brand, team=kind, employmentType="FullTime", isRemote=even, publishedAt=F.concat(day, F.lit("T08:00:00.000+00:00")), id=number),
        "recruitee": _s(careers_url=F.concat(F.lit("https://r.ee/"), number), title=name, location="Rome", department=brand, published_at=F.concat(day, F.lit(" 08:00:00 UTC")), id=F.col("p_partkey")),
        "smartrecruiters": _s(id=number, name=name, location=_s(city="Paris", region="", country="fr"), department=_s(label=brand), typeOfEmployment=_s(label="Part-time"), releasedDate=F.concat(day, F.lit("T08:00:00.000Z"))),
        "pinpoint": _s(url=F.concat(F.lit("https://p.io/"), number), title=name, id=F.col("p_partkey"), location=_s(city="Leeds", province=""), job=_s(department=_s(name=brand)), workplace_type=F.when(even, "remote").otherwise("hybrid")),
        "breezy": _s(url=F.concat(F.lit("https://z.hr/"), number), name=name, id=number, location=_s(city="Rome", is_remote=even), department=_s(name=brand), published_date=F.concat(day, F.lit("T08:00:00.000Z"))),
    }
    return found[platform]


#: The columns that are compared, in SQL: url, location, department, kind, place, remote, posted, id.
_P, _E, _D = "CAST(p_partkey AS STRING)", "p_partkey % 2 = 0", "CAST(DATE '2024-01-01' + p_size AS STRING)"


#: An id of 0 is none.
_SOME = f"CASE WHEN p_partkey = 0 THEN '' ELSE {_P} END"


def _case(yes: str, no: str) -> str:
    return f"CASE WHEN {_E} THEN {yes} ELSE {no} END"


EXPECTED = {
    "workable": (f"'https://apply.workable.com/j/' || {_P}", _case("'Oslo, Norway; Remote'", "'Oslo, Norway; Rome, Italy'"), "''", "''", _case("'remote'", "''"), _case("'true'", "''"), _D, _P),
    "bamboohr": (f"'https://k.bamboohr.com/careers/list?id=' || {_P}", _case("'Oslo, NO'", "'Lazio, Italy'"), "p_brand", "'full_time'", _case("'remote'", "''"), _case("'true'", "'false'"), "''", _P),
    "jibe": (f"'https://k/jobs/' || {_P}", "'Oslo, Norway'", "p_brand", "'contract'", "''", "''", _D, _P),
    "teamtailor": (f"'https://t.co/jobs/' || {_P} || '-a'", "'Oslo, NO'", "p_brand", "''", _case("'remote'", "''"), _case("'true'", "''"), _D, _P),
    "personio": (f"'https://k.jobs.personio.de/job/' || {_P}", "'Berlin; Bonn'", "p_brand", _case("'part_time'", "''"), "''", "''", _D, _P),
    "workday": (f"'k/job/' || {_P}", _case("'Oslo'", "'unknown'"), "''", "'part_time'", "''", "''", _case("'2024-01-30'", "'2024-01-28'"), "''"),
    "oraclecloud": (f"'https://k/hcmUI/CandidateExperience/en/sites/s/job/' || {_P}", _case("'Oslo'", "'unknown/remote'"), "p_brand", _case("'full_time'", "'internship'"), "'hybrid'", "''", _D, _P),
    "phenom": (_case(f"'https://k/us/en/job/' || {_P}", f"'https://a.co/' || {_P}"), _case("'Oslo'", "'Rome'"), "p_brand", "'full_time'", "''", "''", _D, _case(_P, "''")),
    "eightfold": (f"'https://k.eightfold.ai/careers/job/' || {_P}", "'unknown/remote'", "p_brand", "''", _case("'remote'", "'onsite'"), _case("'true'", "''"), _D, _SOME),
    "rippling": (f"'https://r.co/' || {_P}", _case("'Oslo; Rome, Italy, Remote'", "'Oslo; Rome, Italy'"), "p_brand", "''", _case("''", "'hybrid'"), "''", "''", _P),
    "gem": (f"'https://jobs.gem.com/k/' || {_P}", "'Oslo, NOR'", "p_brand", "'full_time'", _case("'remote'", "''"), _case("'true'", "''"), _D, _P),
    "amazon": (f"'https://www.amazon.jobs/en/jobs/' || {_P}", _case("'Oslo'", "'IT, Rome'"), "p_brand", "'full_time'", "''", "''", _D, _P),
    "greenhouse": (f"'https://g.io/' || {_P}", _case("'Oslo'", "'unknown/remote'"), "''", "''", "''", "''", _D, _SOME),
    "lever": (f"'https://l.co/' || {_P}", _case("'Oslo'", "'unknown/remote'"), "p_brand", "'full_time'", _case("'hybrid'", "'onsite'"), "'false'", _D, _SOME),
    "ashby": (f"'https://a.hq/' || {_P}", "'Oslo'", "p_brand", "'full_time'", _case("'remote'", "''"), _case("'true'", "'false'"), _D, _SOME),
    "recruitee": (f"'https://r.ee/' || {_P}", "'Rome'", "p_brand", "''", "''", "''", _D, _SOME),
    "smartrecruiters": (f"'https://jobs.smartrecruiters.com/k/' || {_P}", "'Paris, fr'", "p_brand", "'part_time'", "''", "''", _D, _SOME),
    "pinpoint": (f"'https://p.io/' || {_P}", "'Leeds'", "p_brand", "''", _case("'remote'", "'hybrid'"), _case("'true'", "'false'"), "''", _SOME),
    "breezy": (f"'https://z.hr/' || {_P}", "'Rome'", "p_brand", "''", _case("'remote'", "''"), _case("'true'", "''"), _D, _SOME),
}
COLUMNS = ("url", "location", "department", "kind", "place", "remote", "posted", "id")


def records(s, d, platform: str):
    key = "k,s" if platform == "oraclecloud" else "k"
    return _table(s, d, "part").select(F.lit(platform).alias("platform"), F.lit(key).alias("key"), F.to_json(payload(platform)).alias("record"), F.col("p_partkey").alias("_seq"))


def compared(rows):
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    made = {"url": text("url"), "location": text("location"), "department": text("department"), "kind": text("employment_type"), "place": text("workplace_type"), "remote": text("remote"), "posted": F.coalesce(F.date_format("posted_at", "yyyy-MM-dd"), F.lit("")), "id": text("external_id")}
    return rows.select(F.col("_seq").alias("seq"), "title", *[made[c].alias(c) for c in COLUMNS])


def board(platform: str) -> None:
    shown = ", ".join(f"{x} AS {c}" for x, c in zip(EXPECTED[platform], COLUMNS, strict=True))

    def run(s, d):
        rows = records(s, d, platform)
        made = payloads.parse(rows, platform, F.lit(instant("2024-01-31T10:00:00"))) if platform in payloads.RULES else platforms.parse(rows, platform)
        return compared(made)

    register(f"s34_{platform}", f"SELECT p_partkey AS seq, p_name AS title, {shown} FROM part")(run)


@register("t01_union_of_boards", "SELECT platform, (SELECT count(*) FROM part) AS n FROM (SELECT unnest(['greenhouse', 'lever', 'ashby', 'smartrecruiters', 'recruitee', 'pinpoint', 'breezy']) AS platform)")
def t01(s, d):
    rows = None
    for platform in platforms.PATHS:
        rows = records(s, d, platform) if rows is None else rows.unionByName(records(s, d, platform))
    return platforms.parse_all(rows).groupBy("source.platform").agg(F.count("*").alias("n"))


for name in EXPECTED:
    board(name)
