"""URL normalisation, source hosts and service policies."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote_plus, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query parameters that name a campaign, not a posting.
TRACKING = frozenset("gh_src gh_jid source ref src".split())
TRACKING_PREFIX = "utm_"
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")
_LOCALE = re.compile(r"[A-Za-z]{2}([-_][A-Za-z]{2})?\Z")
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")


def _split(raw: str):
    """Parts of a URL, or None where a strict parser gives up."""
    if any(ord(c) < 32 or ord(c) == 127 for c in raw) or raw.startswith(":") or _BAD_ESCAPE.search(raw.split("?")[0].split("#")[0]):
        return None
    try:
        parts = urlsplit(raw)
        _ = parts.port
    except ValueError:
        return None
    if not parts.scheme and ":" in parts.path.split("/")[0]:
        return None
    return None if " " in parts.netloc else parts


def _pairs(query: str) -> list[tuple[str, str]]:
    kept = "&".join(p for p in query.split("&") if p and ";" not in p and not _BAD_ESCAPE.search(p))
    return parse_qsl(kept, keep_blank_values=True)


def _encoded(pairs: list[tuple[str, str]]) -> str:
    ordered = sorted(pairs, key=lambda kv: kv[0])  # stable: repeated names keep their order
    return "&".join(f"{quote_plus(k, safe='~')}={quote_plus(v, safe='~')}" for k, v in ordered)


def _build(scheme: str, netloc: str, path: str, query: str) -> str:
    out = f"{scheme}:" if scheme else ""
    if netloc:
        out += f"//{netloc}" + ("" if not path or path.startswith("/") else "/")
    return out + path + (f"?{query}" if query else "")


def normalize_url(raw: str | None) -> str:
    """The form of a URL that identifies a posting."""
    text = (raw or "").strip()
    if not text:
        return ""
    parts = _split(text)
    if parts is None:
        return text
    query = parts.query
    if pairs := _pairs(query):
        query = _encoded([(k, v) for k, v in pairs if k not in TRACKING and not k.startswith(TRACKING_PREFIX)])
    path = parts.path.rstrip("/") if len(parts.path) > 1 else parts.path
    return _build(parts.scheme.lower(), parts.netloc.lower(), path, query)


def sweep_url(raw: str | None) -> str:
    """The form in which overlapping boards are compared: no locale, no /apply."""
    parts = _split(raw or "")
    if parts is None or not parts.netloc:
        return ""
    segments = parts.path.strip("/").split("/")
    if segments and _LOCALE.match(segments[0]):
        segments = segments[1:]
    if segments and segments[-1].lower() == "apply":
        segments = segments[:-1]
    pairs = _pairs(parts.query)
    return _build(parts.scheme.lower(), parts.netloc.lower(), "/" + "/".join(segments), _encoded(pairs) if pairs else parts.query)


@F.pandas_udf(StringType())
def normalize_url_udf(urls: pd.Series) -> pd.Series:
    return urls.map(normalize_url)


#: URLs whose form needs no decoding: scheme, host and port, path, query of plain pairs, fragment.
_PLAIN = r"^[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9.-]+(:[0-9]{1,4})?(/[^?#%\x00-\x20\x7f-\xa0]*)?(\?[A-Za-z0-9._~+-]+=[A-Za-z0-9._~+-]*(&[A-Za-z0-9._~+-]+=[A-Za-z0-9._~+-]*)*)?(#[!-~]*)?$"


def url_identity(url: Column) -> Column:
    """``normalize_url`` as a column: plain URLs by built-ins, only others go to Python."""
    bare = F.regexp_replace(url, "#.*$", "")
    base, query = F.regexp_replace(bare, r"\?.*$", ""), F.regexp_extract(bare, r"\?(.*)$", 1)
    site = F.lower(F.regexp_extract(base, r"^([^:]+://[^/]+)", 1))
    path = F.regexp_extract(base, r"^[^:]+://[^/]+(.*)$", 1)
    path = F.when(F.char_length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    name = lambda p: F.regexp_extract(p, "^[^=]*", 0)
    kept = F.filter(F.split(query, "&"), lambda p: ~name(p).isin(*TRACKING) & ~F.startswith(name(p), F.lit(TRACKING_PREFIX)))
    ordered = F.array_sort(F.transform(kept, lambda p, i: F.struct(name(p).alias("name"), i.alias("at"), p.alias("pair"))))
    pairs = F.array_join(F.transform(ordered, lambda x: x["pair"]), "&")
    whole = F.concat(site, path, F.when((query != "") & (pairs != ""), F.concat(F.lit("?"), pairs)).otherwise(""))
    plain = F.coalesce(url.rlike(_PLAIN), F.lit(False))
    return F.when(plain, whole).otherwise(normalize_url_udf(F.when(~plain, url)))


@F.pandas_udf(StringType())
def sweep_url_udf(urls: pd.Series) -> pd.Series:
    return urls.map(sweep_url)


def normal_req(x: Column) -> Column:
    """F22."""
    return F.upper(F.trim(x))


def source_host(key: Column) -> Column:
    """The host that a source key names, null if it names none."""
    bare = F.regexp_replace(F.lower(F.trim(key)), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(bare, r"[/?#|].*$", ""), r":\d+$", "")
    return F.when(host.rlike(r"^([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$"), host)


# What services bear: (requests at once, milliseconds between them, seconds to
# rest after a refusal). Hosts by name; hosts of a domain that count as one service; hosts of a
# domain that each count for themselves.
_USUAL, _GENTLE = (4, 25, 10), (2, 100, 30)
HOSTS = {
    "apply.workable.com": _GENTLE, "www.google.com": _USUAL, "ats.rippling.com": _USUAL, "jobs.gem.com": _USUAL, "api.smartrecruiters.com": _USUAL, "api.lever.co": _USUAL,
    "boards-api.greenhouse.io": _USUAL, "api.ashbyhq.com": _USUAL, "jobs.jobvite.com": _USUAL, "sjobs.brassring.com": _USUAL,
}
ONE_SERVICE = {
    "peopleforce.io": (2, 100, 15), "bamboohr.com": _USUAL, "jibeapply.com": _USUAL, "teamtailor.com": _USUAL, "recruitee.com": _USUAL, "pinpointhq.com": _USUAL,
    "jobs.personio.de": _USUAL, "breezy.hr": _USUAL, "eightfold.ai": _USUAL,
}
EACH_HOST = {"successfactors.com": _GENTLE, "successfactors.eu": _GENTLE, "oraclecloud.com": _USUAL}
OTHERS = (0, 5)


def service_policy(host: Column, default_limit: int = 4, shared: dict[str, str] | None = None) -> Column:
    """service, at_once, pause_ms and rest_s of a host (F30). ``shared`` names hosts that have
    one backend, and its service; an unknown host is a service of its own."""
    make = lambda key, n, pause, rest: F.struct(key.alias("service"), F.lit(n).alias("at_once"), F.lit(pause).alias("pause_ms"), F.lit(rest).alias("rest_s"))
    bounded = lambda key, rule: make(key, min(default_limit, rule[0]), *rule[1:])
    name = F.lower(host)
    rules = [(name == h, F.lit(key), _USUAL) for h, key in (shared or {}).items()]
    rules += [(name == h, name, rule) for h, rule in HOSTS.items()]
    rules += [(name.endswith("." + d), F.lit(".".join(d.split(".")[-2:])), rule) for d, rule in ONE_SERVICE.items()]
    rules += [(name.endswith("." + d), name, rule) for d, rule in EACH_HOST.items()]
    out = make(name, default_limit, *OTHERS)
    for match, key, rule in reversed(rules):
        out = F.when(match, bounded(key, rule)).otherwise(out)
    return out


def host_of(url: str | None) -> str:
    parts = _split(url or "")
    return unquote(parts.hostname or "") if parts else ""
