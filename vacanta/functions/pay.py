"""Pay: periods, annual figures, labels, trust."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Periods in a year, the top of an hourly figure, ranks of provenance, and
# spellings of periods in the feeds of several platforms.
PER_YEAR = {"hour": 2080, "day": 260, "week": 52, "month": 12, "year": 1}
HOURLY_CEILING = 250
TRUST = {"employer": 3, "structured": 2, "description": 1}
PERIOD_WORDS = {
    "hour": "hour", "hourly": "hour", "per-hour-wage": "hour", "1 hour": "hour", "HOUR": "hour",
    "day": "day", "daily": "day", "per-day-wage": "day", "1 day": "day", "DAY": "day",
    "week": "week", "weekly": "week", "per-week-salary": "week", "1 week": "week", "WEEK": "week",
    "month": "month", "monthly": "month", "per-month-salary": "month", "1 month": "month", "MONTH": "month",
    "year": "year", "yearly": "year", "annual": "year", "annually": "year", "per-year-salary": "year", "1 year": "year", "YEAR": "year",
}


def _n(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def has_pay(low: Column, high: Column, summary: Column) -> Column:
    """Something is disclosed (P2): not both ends 0 and no summary."""
    return (_n(low) != 0) | (_n(high) != 0) | (F.coalesce(summary, F.lit("")) != "")


def effective_period(low: Column, high: Column, period: Column) -> Column:
    """The period given, or hour up to the hourly ceiling, else year."""
    top = F.greatest(_n(low), _n(high))
    return F.when(F.coalesce(period, F.lit("")) != "", period).when((top > 0) & (top <= HOURLY_CEILING), "hour").otherwise("year")


def _times(low: Column, high: Column, period: Column) -> Column:
    out, p = F.lit(None).cast("int"), effective_period(low, high, period)
    for name, n in PER_YEAR.items():
        out = F.when(p == name, n).otherwise(out)
    return F.coalesce(out, F.lit(0))  # an unknown period annualises to 0


def annual_max(low: Column, high: Column, period: Column) -> Column:
    """The larger end over a year; null if nothing is disclosed."""
    top = F.greatest(_n(low), _n(high))
    return F.when(top > 0, top * _times(low, high, period))


def annual_min(low: Column, high: Column, period: Column) -> Column:
    """The lower end, or else the upper, over a year; null if neither is."""
    bottom = F.when(_n(low) > 0, _n(low)).otherwise(_n(high))
    return F.when(bottom > 0, bottom * _times(low, high, period))


def trust(provenance: Column) -> Column:
    """Rank of a provenance; unknown ones rank lowest."""
    out = F.lit(0)
    for name, rank in TRUST.items():
        out = F.when(provenance == name, rank).otherwise(out)
    return out


def period_of(raw: Column) -> Column:
    """A feed's word for a period (F48), null if unknown."""
    words = F.create_map(*[F.lit(x) for kv in PERIOD_WORDS.items() for x in kv])
    return F.coalesce(F.try_element_at(words, F.trim(raw)), F.try_element_at(words, F.lower(F.trim(raw))))


def build(low: Column, high: Column, currency: Column, period: Column, summary: Column, provenance: str) -> Column:
    """A compensation struct, null if nothing is disclosed; one figure fills both ends."""
    a, b = _n(low), _n(high)
    return F.when(
        (a > 0) | (b > 0) | (F.coalesce(summary, F.lit("")) != ""),
        F.struct(
            F.when(a > 0, a).otherwise(b).alias("min"), F.when(b > 0, b).otherwise(a).alias("max"),
            currency.alias("currency"), period_of(period).alias("period"), summary.alias("summary"), F.lit(provenance).alias("provenance"),
        ),
    )


def amount(x: Column) -> Column:
    """Thousands separators, and two places only for fractions."""
    return F.when(x == F.floor(x), F.format_number(x, 0)).otherwise(F.format_number(x, 2))


def plain(x: Column) -> Column:
    """A figure without separators and without a needless fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def label(low: Column, high: Column, currency: Column, period: Column, summary: Column) -> Column:
    """The summary, or else CUR min-max/period (K7)."""
    a, b = _n(low), _n(high)
    span = F.when((a > 0) & (b > 0) & (a != b), F.concat(plain(a), F.lit("-"), plain(b))).when(b > 0, plain(b)).otherwise(plain(a))
    named = F.concat(F.when(F.coalesce(currency, F.lit("")) != "", F.concat(currency, F.lit(" "))).otherwise(""), span)
    per = F.when(F.coalesce(period, F.lit("")) != "", F.concat(F.lit("/"), period)).otherwise("")
    return F.when(F.coalesce(summary, F.lit("")) != "", summary).otherwise(F.concat(named, per))


def axis_step(span: Column, ticks: int = 5) -> Column:
    """A step of 1, 2, 2.5 or 5 times a power of ten."""
    raw = span / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    lead = raw / power
    return power * F.when(lead <= 1, 1.0).when(lead <= 2, 2.0).when(lead <= 2.5, 2.5).when(lead <= 5, 5.0).otherwise(10.0)
