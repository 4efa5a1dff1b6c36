"""Identities as hashes: dedupe keys, corpus ids, descriptors, plan ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The domain of corpus ids, and the hexadecimal digits of a key.
ID_DOMAIN, HEX = "jht-corpus-id-v1", 32


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts])


def short_sha(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, HEX)


def identity(url: Column, company: Column, title: Column, location: Column) -> Column:
    """What two postings share when they are one: the URL, or else company, title and location."""
    return F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(_joined(company, title, location))


def dedupe_key(url: Column, company: Column, title: Column, location: Column) -> Column:
    """F23."""
    return short_sha(identity(url, company, title, location))


def descriptor(title: Column, location: Column) -> Column:
    """F25."""
    return F.sha2(_joined(title, location), 256)


def corpus_id(platform: Column, key: Column, basis: Column, value: Column) -> Column:
    """scoped to the source, each part closed by a NUL."""
    return short_sha(F.concat(_joined(F.lit(ID_DOMAIN), platform, key, basis, value), F.lit("\0")))


def evidence_hash(kind: Column, key: Column) -> Column:
    """a 64-bit key for joins."""
    return F.xxhash64(kind, key)


def lines_id(lines: Iterable[str]) -> str:
    """a hash of sorted lines, the same for any order."""
    h = hashlib.sha256()
    for line in sorted(lines):
        h.update(line.encode() + b"\n")
    return h.hexdigest()[:HEX]


def source_set_id(sources: Iterable[tuple[str, str]]) -> str:
    return lines_id(f"{platform}\t{key}" for platform, key in sources)
