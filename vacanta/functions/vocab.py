"""Employment and workplace vocabulary, remote and hybrid heuristics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results must agree on.
EMPLOYMENT_TYPES = ("full_time", "part_time", "contract", "temporary", "internship", "volunteer")
WORKPLACE_TYPES = ("remote", "hybrid", "onsite")
REMOTE_TERMS = (
    "remote", "anywhere", "work from home", "work-from-home", "wfh",
    "telecommute", "distributed", "virtual", "home based", "home-based",
)
EMPLOYMENT_EXACT = {"ft": "full_time", "pt": "part_time", "temp": "temporary"}
EMPLOYMENT_WORDS = (
    ("fulltime", "full_time"), ("parttime", "part_time"), ("internship", "internship"),
    ("contractor", "contract"), ("contract", "contract"), ("freelance", "contract"),
    ("temporary", "temporary"), ("seasonal", "temporary"), ("volunteer", "volunteer"), ("intern", "internship"),
)
WORKPLACE_EXACT = {"wfh": "remote"}
WORKPLACE_WORDS = (
    ("hybrid", "hybrid"), ("remote", "remote"), ("workfromhome", "remote"), ("telecommute", "remote"),
    ("distributed", "remote"), ("anywhere", "remote"), ("onsite", "onsite"), ("onlocation", "onsite"),
    ("inperson", "onsite"), ("inoffice", "onsite"), ("office", "onsite"),
)


def either(conditions: Sequence[Column]) -> Column:
    """OR over conditions; false for none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False)) if conditions else F.lit(False)


def fold(x: Column) -> Column:
    """Lower case, where the dotted capital I is one letter as in the source data."""
    return F.lower(F.translate(x, "İ", "i"))


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(x, r"^[\p{Z}\s]+", ""), r"[\p{Z}\s]+$", "")


def squash(x: Column) -> Column:
    """Letters and digits only, lower-cased."""
    return F.regexp_replace(fold(x), r"[^\p{L}\p{Nd}]", "")


def bind(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _normal(raw: Column, exact: dict[str, str], values: Sequence[str], words: Sequence[tuple[str, str]]) -> Column:
    return bind(squash(raw), lambda key: _named(key, exact, values, words))


def _named(key: Column, exact: dict[str, str], values: Sequence[str], words: Sequence[tuple[str, str]]) -> Column:
    out = F.when(F.coalesce(key, F.lit("")) == "", F.lit(None).cast("string"))
    for spelt, value in exact.items():
        out = out.when(key == spelt, F.lit(value))
    for value in values:
        out = out.when(key == value.replace("_", ""), F.lit(value))
    for word, value in words:
        out = out.when(F.contains(key, F.lit(word)), F.lit(value))
    return out


def employment_type(raw: Column) -> Column:
    """The canonical employment type or null (F1)."""
    return _normal(raw, EMPLOYMENT_EXACT, EMPLOYMENT_TYPES, EMPLOYMENT_WORDS)


def workplace_type(raw: Column) -> Column:
    """The canonical workplace type or null (F2)."""
    return _normal(raw, WORKPLACE_EXACT, WORKPLACE_TYPES, WORKPLACE_WORDS)


def has_term(text: Column, terms: Sequence[str]) -> Column:
    """Whether the folded text holds one of the folded terms; the text is folded once."""
    text = fold(F.coalesce(text, F.lit("")))
    if len(terms) == 1:
        return F.contains(text, F.lit(terms[0]))
    quoted = ["\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E" for t in terms]
    return F.rlike(text, F.lit("|".join(quoted))) if terms else F.lit(False)


def looks_remote(location: Column, title: Column) -> Column:
    """A remote term in location or title."""
    return has_term(F.concat_ws("\0", location, title), REMOTE_TERMS)


def looks_hybrid(location: Column, title: Column) -> Column:
    return has_term(F.concat_ws("\0", location, title), ["hybrid"])


def is_remote(remote: Column, location: Column, title: Column) -> Column:
    """The structured flag, or else the heuristic."""
    return F.coalesce(remote, looks_remote(location, title))
