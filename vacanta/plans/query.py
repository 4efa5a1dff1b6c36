"""The query vocabulary: a conjunction of eleven predicates, and its employer twin.

Terms are folded once on the driver and reach the plan as literals; conditions stand in
the order instants, numbers, text, heuristics. Unknown values never satisfy a filter; blank terms mean
no constraint.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields, replace
from datetime import datetime, timedelta, timezone
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pay, vocab
from ..functions.vocab import either


def terms(values: Iterable[str]) -> list[str]:
    """Trimmed, folded, without blanks."""
    return [t for v in values if (t := v.strip().replace("İ", "i").lower())]


def any_term(x: Column, wanted: list[str]) -> Column:
    """Whether a folded column holds one of the terms."""
    return vocab.has_term(x, wanted)


@dataclass(frozen=True)
class Query:
    remote: bool = False
    has_compensation: bool = False
    min_annual: float = 0.0
    titles: tuple[str, ...] = ()
    exclude_titles: tuple[str, ...] = ()
    locations: tuple[str, ...] = ()
    companies: tuple[str, ...] = ()
    departments: tuple[str, ...] = ()
    employment_types: tuple[str, ...] = ()
    workplace_types: tuple[str, ...] = ()
    posted_since: datetime | None = None

    def is_zero(self) -> bool:
        """No constraint at all."""
        texts = (self.titles, self.exclude_titles, self.locations, self.companies, self.departments, self.employment_types, self.workplace_types)
        return not (self.remote or self.has_compensation or self.min_annual > 0 or self.posted_since or any(terms(t) for t in texts))

    def condition(self) -> Column:
        """One Boolean column, never null."""
        c = F.col
        pay_of = lambda f: c("compensation")[f]
        out: list[Column] = []
        # cheap tests first: a row that fails one is not asked the others
        if self.posted_since is not None:
            out.append(F.coalesce(c("posted_at") >= F.lit(self.posted_since), F.lit(False)))
        if self.has_compensation:
            out.append(c("compensation").isNotNull() & pay.has_pay(pay_of("min"), pay_of("max"), pay_of("summary")))
        if self.min_annual > 0:
            out.append(F.coalesce(pay.annual_max(pay_of("min"), pay_of("max"), pay_of("period")) >= self.min_annual, F.lit(False)))
        for column, wanted in (("title", self.titles), ("location", self.locations), ("company", self.companies)):
            if found := terms(wanted):
                out.append(any_term(c(column), found))
        if found := terms(self.exclude_titles):
            out.append(~any_term(c("title"), found))
        if found := terms(self.departments):
            out.append(any_term(F.concat_ws("\0", "department", "team"), found))
        if self.remote:
            out.append(vocab.is_remote(c("remote"), c("location"), c("title")))
        if types := terms(self.employment_types):
            out.append(F.coalesce(c("employment_type").isin(types), F.lit(False)))
        if types := terms(self.workplace_types):
            guess = []
            if "remote" in types:
                guess.append(vocab.is_remote(c("remote"), c("location"), c("title")))
            if "hybrid" in types:
                guess.append(vocab.looks_hybrid(c("location"), c("title")))
            known = F.coalesce(c("workplace_type"), F.lit("")) != ""
            out.append(F.when(known, c("workplace_type").isin(types)).otherwise(either(guess)))
        condition = F.lit(True)
        for x in out:
            condition = condition & x
        return F.coalesce(condition, F.lit(False))

    def apply(self, postings: DataFrame) -> DataFrame:
        """The rows that match; the same frame for a zero query."""
        return postings if self.is_zero() else postings.filter(self.condition())

    def pruned(self, sources: DataFrame) -> tuple[DataFrame, Query]:
        """Sources that the company terms leave, and the query without them."""
        return matching_sources(sources, self.companies), replace(self, companies=())


def matching_sources(sources: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Sources whose company or key holds a term; all without terms."""
    found = terms(wanted)
    return sources.filter(any_term(F.col("company"), found) | any_term(F.col("key"), found)) if found else sources


def check_scope(sources: DataFrame, wanted: Iterable[str], most: int = 200) -> DataFrame:
    """The sources of a live search, or an error for none, for too many or for no company."""
    if not terms(wanted):
        raise ValueError("a live search needs a company")
    found = matching_sources(sources, wanted)
    n = found.limit(most + 1).count()
    if n == 0:
        raise ValueError("no source matches these companies")
    if n > most:
        raise ValueError(f"more than {most} sources match; name fewer companies")
    return found


@dataclass(frozen=True)
class EmployerFilter:
    """P18-P22, over postings that carry a nullable struct ``employer``."""

    known: bool = False
    public: bool = False
    private: bool = False
    min_employees: int = 0
    industries: tuple[str, ...] = ()

    def is_zero(self) -> bool:
        return not (self.known or self.public or self.private or self.min_employees > 0 or terms(self.industries))

    def condition(self) -> Column:
        e = lambda f: F.col("employer")[f]
        out = F.col("employer").isNotNull()
        if self.public:
            out = out & e("public")
        if self.private:
            out = out & ~e("public")
        if self.min_employees > 0:
            out = out & (F.coalesce(e("employees"), F.lit(0)) >= self.min_employees)
        if found := terms(self.industries):
            out = out & (any_term(e("industry"), found) | any_term(e("sic"), found))
        return F.coalesce(out, F.lit(False))

    def apply(self, postings: DataFrame) -> DataFrame:
        return postings if self.is_zero() else postings.filter(self.condition())


def parse_enums(values: Iterable[str], kind: str, spellings: bool = True) -> tuple[str, ...]:
    """Canonical employment or workplace types; an unknown value is an error. ``spellings``
    takes any board's spelling, else only canonical values are taken."""
    exact, canon, words = (
        (vocab.EMPLOYMENT_EXACT, vocab.EMPLOYMENT_TYPES, vocab.EMPLOYMENT_WORDS)
        if kind == "employment"
        else (vocab.WORKPLACE_EXACT, vocab.WORKPLACE_TYPES, vocab.WORKPLACE_WORDS)
    )
    out = []
    for raw in values:
        if not raw.strip():
            continue
        key = "".join(ch for ch in raw.lower() if ch.isalpha() or ch.isdigit())
        found = raw.strip() if raw.strip() in canon else None
        if found is None and spellings:
            found = exact.get(key) or next((v for v in canon if v.replace("_", "") == key), None) or next((v for w, v in words if w in key), None)
        if found is None:
            raise ValueError(f"unknown {kind} type {raw!r}: one of {', '.join(canon)}")
        out.append(found)
    return tuple(out)


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_STEP = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)")


def parse_age(value: str) -> timedelta:
    """Days (3d), weeks (1.5w) or durations such as 1h30m."""
    text = value.strip().lower()
    if m := re.fullmatch(r"([+-]?(?:\d+\.?\d*|\.\d+))([dw])", text):
        return timedelta(days=float(m[1]) * (7 if m[2] == "w" else 1))
    sign, body = (-1, text[1:]) if text.startswith("-") else (1, text.removeprefix("+"))
    if not body or "".join(m[0] for m in _STEP.finditer(body)) != body:
        raise ValueError(f"not an age: {value!r}")
    return timedelta(seconds=sign * sum(float(m[1]) * _UNITS[m[2]] for m in _STEP.finditer(body)))


def parse_posted_since(value: str, now: datetime) -> datetime | None:
    """An instant, a date or an age before ``now``; blank is none."""
    text = value.strip()
    if not text:
        return None
    if re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        return datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=timezone.utc)
    if re.match(r"\d{4}-\d\d-\d\dT", text):
        found = datetime.fromisoformat(text.replace("Z", "+00:00"))
        if found.tzinfo is None:
            raise ValueError(f"an instant needs an offset: {value!r}")
        return found
    age = parse_age(text)
    if age <= timedelta(0):
        raise ValueError(f"an age must be positive: {value!r}")
    return now - age


def tool_recency(posted_since: str | None, within_days: int | None, now: datetime) -> datetime | None:
    """Either an instant or a number of days, not both."""
    if posted_since and within_days:
        raise ValueError("give posted_since or posted_within_days, not both")
    if within_days is not None and within_days < 0:
        raise ValueError("posted_within_days must not be negative")
    return now - timedelta(days=within_days) if within_days else parse_posted_since(posted_since or "", now)


#: The names of a query's fields; each must affect is_zero and condition.
FIELDS = tuple(f.name for f in fields(Query))
