"""Spark schemas of the engine's tables, built without a session (workers import them too)."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def struct(**fields: str | T.DataType) -> T.StructType:
    """Fields by name; a type's name, ``ints`` or ``strings`` for arrays, or a type."""
    arrays = {"ints": T.ArrayType(T.IntegerType()), "strings": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, k if isinstance(k, T.DataType) else arrays.get(k) or _KINDS[k]) for n, k in fields.items()])


def _many(kind: str, names: str) -> dict[str, str]:
    return dict.fromkeys(names.split(), kind)


SOURCE = struct(platform="string", key="string")
COMPENSATION = struct(min="double", max="double", **_many("string", "currency period summary provenance"))
POSTING = struct(
    **_many("string", "company url title location"),
    compensation=COMPENSATION,
    remote="boolean",
    **_many("string", "department team employment_type workplace_type seniority"),
    **_many("timestamp", "posted_at updated_at"),
    **_many("string", "requisition_id external_id"),
    source=SOURCE,
)
POSTINGS = T.StructType([*POSTING.fields, T.StructField("_seq", T.LongType())])
CLOSURE = struct(last_seen="timestamp", confirmed_at="timestamp", reason="string")
CORPUS_ROWS = struct(
    **_many("string", "id basis dedupe_key"), **_many("timestamp", "first_seen last_seen"), **_many("int", "missing reopens"), closed=CLOSURE, posting=POSTING
)
CORPUS_SOURCES = struct(
    source=SOURCE, company="string", retired="boolean", **_many("timestamp", "last_attempt last_qualifying"), last_duration_ms="long", last_postings="int",
    trailing="ints", **_many("int", "empty_streak consecutive_failures"), requisition_unsafe="boolean", open="int",
)
SOURCE_RUNS = struct(
    **_many("string", "platform key company status"), **_many("timestamp", "started_at finished_at"), duration_ms="long", **_many("int", "postings errors"), error_class="string"
)
MATCH = struct(method="string", confidence="string", data_sources="strings", retrieved_at="string")
WAGE = struct(**_many("string", "soc occupation area source"), n="int", **_many("double", "p25 p50 p75"), as_of="string")
EMPLOYERS = struct(
    source=SOURCE, **_many("string", "company legal_name cik ticker exchange sic industry"), public="boolean", **_many("int", "employees founded"),
    **_many("string", "headquarters parent wikidata_id"), match=MATCH, wage_benchmarks=T.ArrayType(WAGE),
)
SCHED_SOURCES = struct(
    **_many("string", "platform key company group"), **_many("timestamp", "last_attempt last_success"), duration_ms="ints", postings="ints",
    consecutive_failures="int", error_class="string", retired="boolean", retired_at="timestamp",
)
SCHED_GROUPS = struct(key="string", parallelism_milli="int", observed_at="timestamp", samples="int")
STAMP = struct(index="int", count="int", **_many("string", "plan_id source_set_id commit"))
MANIFEST = struct(
    schema_version="int", status="string", **_many("timestamp", "started_at finished_at"), **_many("long", "budget_ms postings"), shard=STAMP, sources=T.ArrayType(SOURCE_RUNS)
)
#: The flat column names of a stored corpus, in order.
FLAT = (
    "id basis dedupe_key first_seen last_seen missing reopens closed_last_seen closed_confirmed_at closed_reason platform source_key "
    "company url title location department team employment_type workplace_type seniority requisition_id external_id remote posted_at "
    "updated_at compensation compensation_min compensation_max compensation_currency compensation_period compensation_summary "
    "compensation_provenance"
).split()
