"""Fields of platform payloads: facets, locations, loose scalars, detail lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import employment_type, strip, workplace_type


def facet(facets: Column, labels: list[str], exclude: list[str] = ()) -> Column:
    """The value of the first wanted label that a facet's label holds, but for excluded ones
    (F12). ``facets`` is an array of (label, value)."""
    name = lambda f: F.lower(f["label"])
    none = lambda f: ~F.exists(F.array(*[F.lit(x.lower()) for x in exclude]), lambda e: F.contains(name(f), e)) if exclude else F.lit(True)
    wanted = lambda x: lambda f: F.contains(name(f), F.lit(x.lower())) & none(f) & (f["value"] != "")
    picks = [F.try_element_at(F.filter(facets, wanted(x)), F.lit(1))["value"] for x in labels]
    return F.coalesce(*picks)


def location(parts: Column, separator: str = ", ", default: str = "unknown") -> Column:
    """Distinct non-blank parts joined, or the default."""
    joined = F.array_join(F.array_distinct(F.filter(F.transform(parts, strip), lambda x: x != "")), separator)
    return F.when(F.coalesce(joined, F.lit("")) != "", joined).otherwise(default)


def remote_location(parts: Column, remote: Column) -> Column:
    """As location; without parts, remote or unknown."""
    found = location(parts, default="")
    return F.when(found != "", found).when(F.coalesce(remote, F.lit(False)), "remote").otherwise("unknown")


def scalar(json: Column, path: str) -> Column:
    """A string, number, Boolean or first array entry as text."""
    raw = F.get_json_object(json, path)
    first = F.get_json_object(json, path + "[0]")
    return F.when(F.startswith(raw, F.lit("[")), first).otherwise(raw)


def one_or_many(json: Column, path: str) -> Column:
    """An array of text from a single value or a list."""
    raw = F.get_json_object(json, path)
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).otherwise(F.array(raw))


def requisition(bullets: Column) -> Column:
    """The first entry of 3 to 40 characters with a letter and a digit and no space."""
    good = lambda x: F.char_length(x).between(3, 40) & ~F.contains(x, F.lit(" ")) & x.rlike(r"\p{L}") & x.rlike(r"\d")
    return F.try_element_at(F.filter(bullets, good), F.lit(1))


def unlabelled_employment(values: Column) -> Column:
    """The first value that reads as an employment type (F16)."""
    return F.try_element_at(F.filter(F.transform(values, employment_type), lambda x: x.isNotNull()), F.lit(1))


def two_field_employment(tenure: Column, schedule: Column) -> Column:
    """Tenure first, then schedule unless it names both full and part time."""
    low = F.lower(F.coalesce(schedule, F.lit("")))
    both = F.contains(low, F.lit("full")) & F.contains(low, F.lit("part"))
    return F.coalesce(employment_type(tenure), F.when(~both, employment_type(schedule)))


def details(line: Column) -> Column:
    """department, employment_type, workplace_type, location from a comma-separated line."""
    parts = F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x)), lambda x: x != "")
    place = F.try_element_at(parts, F.lit(-1))
    rest = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    kind = F.try_element_at(F.filter(F.transform(rest, employment_type), lambda x: x.isNotNull()), F.lit(1))
    other = F.try_element_at(F.filter(rest, lambda x: employment_type(x).isNull()), F.lit(1))
    return F.struct(
        F.when(F.size(parts) > 2, other).alias("department"), kind.alias("employment_type"), workplace_type(place).alias("workplace_type"), place.alias("location")
    )


def search_name(name: Column) -> Column:
    """A saved search's name: trimmed, one space, 60 characters at most."""
    return F.substring(F.regexp_replace(F.trim(name), r"\s+", " "), 1, 60)


def embedded_json(page: Column, kind: str) -> Column:
    """The first script of a page with this type or id, as text."""
    return F.nullif(F.regexp_extract(page, rf"(?s)<script[^>]*(?:type|id)=[\"']{kind}[\"'][^>]*>(.*?)</script>", 1), F.lit(""))
