"""What leaves the engine: NDJSON, CSV, lines of text, shard keys, TSV, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pay
from ..functions.hashes import dedupe_key

CORE = ("company", "url", "title", "location", "compensation", "remote", "department", "team")
EXTENDED = (
    "employment_type", "workplace_type", "seniority", "posted_at", "updated_at", "requisition_id", "external_id", "platform", "source_key",
    "compensation_min", "compensation_max",
)


def _iso(x: Column) -> Column:
    return F.coalesce(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def renderers() -> dict[str, Column]:
    """Each CSV column as text (K5)."""
    c, p = F.col, (lambda f: F.col("compensation")[f])
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    has = F.coalesce(c("compensation").isNotNull() & pay.has_pay(p("min"), p("max"), p("summary")), F.lit(False))
    out = {n: text(c(n)) for n in (*CORE, *EXTENDED[:3], *EXTENDED[5:7]) if n not in ("compensation", "remote")}
    out["compensation"] = F.when(has, pay.label(p("min"), p("max"), p("currency"), p("period"), p("summary"))).otherwise("")
    out["remote"] = F.when(c("remote").isNull(), "").when(c("remote"), "true").otherwise("false")
    for n in ("posted_at", "updated_at"):
        out[n] = _iso(c(n))
    out["platform"], out["source_key"] = text(c("source.platform")), text(c("source.key"))
    for n in ("min", "max"):
        out[f"compensation_{n}"] = F.when(has & (F.coalesce(p(n), F.lit(0.0)) > 0), pay.plain(p(n))).otherwise("")
    return out


def resolve_columns(columns: list[str] | None, extended: bool = False) -> tuple[list[str], bool]:
    """Validated column names, and whether a header is written (K2-K4)."""
    names = list(columns) if columns else [*CORE, *(EXTENDED if extended else ())]
    known = {*CORE, *EXTENDED}
    if bad := [n for n in names if n not in known]:
        raise ValueError(f"unknown column {bad[0]!r}")
    return names, bool(columns) and any(n not in CORE for n in names)


def csv_frame(postings: DataFrame, columns: list[str] | None = None, extended: bool = False) -> DataFrame:
    names, _ = resolve_columns(columns, extended)
    made = renderers()
    return postings.select(*[made[n].alias(n) for n in names])


def write_csv(postings: DataFrame, path: str, columns: list[str] | None = None, extended: bool = False) -> None:
    _, header = resolve_columns(columns, extended)
    csv_frame(postings, columns, extended).write.mode("overwrite").option("header", header).option("emptyValue", "").csv(path)


def json_lines(postings: DataFrame) -> DataFrame:
    """One JSON object a row; absent enrichment is left out, the core four never are (K1)."""
    core = [F.coalesce(n, F.lit("")).alias(n) for n in ("company", "url", "title", "location")]
    rest = [F.col(n) for n in postings.columns if n not in ("company", "url", "title", "location", "_seq")]
    return postings.select(F.to_json(F.struct(*core, *rest), {"ignoreNullFields": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'", "timeZone": "UTC"}).alias("value"))


def write_json(postings: DataFrame, path: str) -> None:
    json_lines(postings).write.mode("overwrite").text(path)


def detail(postings: DataFrame) -> Column:
    """The conditional tail of a posting's line (K6)."""
    c, p = F.col, (lambda f: F.col("compensation")[f])
    part = lambda cond, label, value: F.when(F.coalesce(cond, F.lit(False)), F.concat(F.lit(f" {label}: "), value)).otherwise("")
    far = c("workplace_type").isin("remote", "hybrid") & ~F.contains(F.lower("location"), c("workplace_type"))
    kind = (c("employment_type") != "") & (c("employment_type") != "full_time")
    has = c("compensation").isNotNull() & pay.has_pay(p("min"), p("max"), p("summary"))
    return F.concat(
        part(far, "workplace", c("workplace_type")),
        part(kind, "type", c("employment_type")),
        part(has, "pay", pay.label(p("min"), p("max"), p("currency"), p("period"), p("summary"))),
        part(c("posted_at").isNotNull(), "posted", F.date_format("posted_at", "yyyy-MM-dd")),
    )


def shard_lines(postings: DataFrame) -> DataFrame:
    """key, company, platform of every posting."""
    c = F.col
    return postings.select(dedupe_key(c("url"), c("company"), c("title"), c("location")).alias("key"), "company", c("source.platform").alias("platform"))


def tsv_frame(df: DataFrame) -> DataFrame:
    """Text columns for a TSV; a tab or line break in a cell is an error."""
    cell = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    bad = lambda n: F.raise_error(F.concat(F.lit(f"a tab or line break in {n}: "), cell(n)))
    return df.select(*[F.when(cell(n).rlike(r"[\t\r\n]"), bad(n)).otherwise(cell(n)).alias(n) for n in df.columns])


def write_tsv(df: DataFrame, path: str) -> None:
    tsv_frame(df).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "\0").option("emptyValue", "").csv(path)


def result_items(postings: DataFrame) -> DataFrame:
    """Items of a result list with formatted pay."""
    p = lambda f: F.col("compensation")[f]
    span = F.when((p("min") > 0) & (p("max") > 0) & (p("min") != p("max")), F.concat(pay.amount(p("min")), F.lit(" - "), pay.amount(p("max"))))
    one = F.greatest(F.coalesce(p("min"), F.lit(0.0)), F.coalesce(p("max"), F.lit(0.0)))
    shown = F.when(F.coalesce(p("summary"), F.lit("")) != "", p("summary")).otherwise(F.coalesce(span, F.when(one > 0, pay.amount(one)), F.lit("")))
    return postings.withColumn("pay", shown)


def churn_report(churn: DataFrame, refused: DataFrame) -> DataFrame:
    """Outcomes and refusals as one two-column table."""
    a = churn.select(F.col("outcome").alias("what"), "n")
    return a.unionByName(refused.select(F.concat(F.lit("refused: "), F.col("verdict")).alias("what"), "n"))


def findings_json(found: DataFrame) -> DataFrame:
    """A JSON line for every finding."""
    return found.select(F.to_json(F.struct(*found.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_findings(found: DataFrame, path: str) -> None:
    findings_json(found).write.mode("overwrite").text(path)


def overlap_report(found: DataFrame) -> str:
    """A Markdown table of all findings, strongest first."""
    rows = found.orderBy(F.desc("strength"), "a", "b").toLocalIterator()
    lines = ["| a | b | raw | url | req | strength |", "| --- | --- | ---: | ---: | ---: | ---: |"]
    return "\n".join(lines + [f"| {r['a']} | {r['b']} | {r['raw']} | {r['url']} | {r['req']} | {r['strength']:.3f} |" for r in rows])


def tool_payload(page: DataFrame, truncated: bool = False) -> dict:
    """The structured result of a tool, and the same as text (K21). ``page`` is one page."""
    items = [json.loads(r["value"]) for r in page.select(F.to_json(F.struct(*page.columns)).alias("value")).collect()]  # a page's rows
    content = {"items": items, "truncated": truncated}
    return {"content": [{"type": "text", "text": json.dumps(content)}], "structuredContent": content, "isError": False}


def tool_refusal(reason: str) -> dict:
    return {"content": [{"type": "text", "text": reason}], "structuredContent": {"error": reason}, "isError": True}
