"""Further registered queries: payload fields, dates, seeds, windows, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, pay, text, urls
from ..operators import corpus, dedupe, employers, record, resolve, schedule, search, shards, sinks
from ..operators.storage import cut
from ..plans.query import Query
from ..sources import readers
from .queries import _DAYS, _EVID, _days, _employers, _facts, _runs, instant, register
from .views import typed_postings, view


def _table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


@register("f13_location", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'unknown' WHEN s_suppkey % 3 = 1 THEN n_name ELSE n_name || ', ' || r_name END AS location FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def f13(s, d):
    rows = _table(s, d, "supplier").join(_table(s, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(_table(s, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    m = F.col("s_suppkey") % 3
    parts = F.array(F.when(m > 0, F.concat(F.lit(" "), "n_name")).otherwise(""), F.when(m == 2, F.col("r_name")).otherwise(" "), F.when(m > 0, F.col("n_name")).otherwise(""))
    return rows.select("s_suppkey", text.location(parts).alias("location"))


@register("f14_loose_scalar", "SELECT event_id, CAST(props->>'$.k' AS STRING) AS k FROM events")
def f14(s, d):
    return _table(s, d, "events").select("event_id", text.scalar(F.col("props"), "$.k").alias("k"))


@register("f15_requisition", "SELECT l_orderkey AS o, l_linenumber AS l, CASE WHEN l_orderkey >= 10 THEN 'R' || CAST(l_orderkey AS STRING) END AS req, count(*) AS n FROM lineitem GROUP BY ALL")
def f15(s, d):
    bullets = F.array(F.lit("Posted today"), F.lit("Full"), F.concat(F.lit("R"), F.col("l_orderkey").cast("string")))
    rows = _table(s, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), text.requisition(bullets).alias("req"))
    return rows.groupBy("o", "l", "req").agg(F.count("*").alias("n"))


@register("f22_requisition_form", "SELECT o_orderkey, upper(o_orderpriority) AS req FROM orders")
def f22(s, d):
    return _table(s, d, "orders").select("o_orderkey", urls.normal_req(F.concat(F.lit("  "), F.lower("o_orderpriority"))).alias("req"))


_HOSTS = ("API.Lever.co", "t.bamboohr.com", "acme.jobs.personio.de", "x.successfactors.eu", "a.peopleforce.io", "jobs.example.org", "apply.workable.com", "one.example.net", "breezy.hr")
_POLICIES = (("api.lever.co", 4, 25, 10), ("bamboohr.com", 4, 25, 10), ("personio.de", 4, 25, 10), ("x.successfactors.eu", 2, 100, 30), ("peopleforce.io", 2, 100, 15), ("jobs.example.org", 8, 0, 5), ("apply.workable.com", 2, 100, 30), ("example", 4, 25, 10), ("breezy.hr", 8, 0, 5))
_POLICY_VALUES = ", ".join(f"({i}, '{k}', {n}, {p}, {r})" for i, (k, n, p, r) in enumerate(_POLICIES))


@register("f30_service_policy", f"SELECT page_id, service, at_once, pause_ms, rest_s FROM pages JOIN (VALUES {_POLICY_VALUES}) t(i, service, at_once, pause_ms, rest_s) ON i = page_id % 9")
def f30(s, d):
    host = F.element_at(F.array(*map(F.lit, _HOSTS)), (F.col("page_id") % 9 + 1).cast("int"))
    return _table(s, d, "pages").select("page_id", urls.service_policy(host, 8, {"one.example.net": "example"}).alias("p")).select("page_id", "p.*")


@register("f51_amount", "SELECT DISTINCT p_retailprice AS x, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS INT) AS STRING) ELSE printf('%.2f', p_retailprice) END AS shown FROM part")
def f51(s, d):
    return _table(s, d, "part").select(F.col("p_retailprice").alias("x"), pay.amount(F.col("p_retailprice")).alias("shown")).distinct()


@register("f66_epoch", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') END AS day FROM events")
def f66(s, d):
    millis = F.when(F.col("user_id") % 2 == 0, F.unix_millis(F.col("ts").cast("timestamp"))).otherwise(0)
    return _table(s, d, "events").select("event_id", F.date_format(dates.epoch(millis, True), "yyyy-MM-dd").alias("day"))


@register("f67_round_trip", "SELECT count(*) AS n, count(*) AS same FROM events")
def f67(s, d):
    at = F.date_trunc("millisecond", F.col("ts").cast("timestamp"))
    return _table(s, d, "events").agg(F.count("*").alias("n"), F.count_if(dates.decode(dates.encode(at)) == at).alias("same"))


@register("f68_age_hours", "SELECT o_orderkey, (epoch(TIMESTAMP '2002-01-01 00:00:00') - epoch(o_orderdate)) / 3600 AS hours FROM orders")
def f68(s, d):
    now = F.lit(instant("2002-01-01T00:00:00"))
    return _table(s, d, "orders").select("o_orderkey", dates.age_hours(now, F.col("o_orderdate").cast("timestamp")).alias("hours"))


@register("s28_seed_ciks", "SELECT user_id AS cik, min(event_id) AS row_idx, arg_min(event_type, event_id) AS ticker FROM events GROUP BY 1")
def s28(s, d):
    rows = _table(s, d, "events").select(F.col("user_id").alias("cik"), F.col("event_id").alias("row_idx"), F.col("event_type").alias("ticker"), F.lit("").alias("name"))
    return readers.seed_ciks(rows).select("cik", "row_idx", "ticker")


@register("s30_merge_bindings", "SELECT user_id AS cik, min(event_type) AS wikidata_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS websites FROM events GROUP BY 1")
def s30(s, d):
    rows = _table(s, d, "events").select(F.col("user_id").alias("cik"), F.col("event_type").alias("wikidata_id"), F.lit("").alias("parent"), F.col("event_type").alias("website"))
    return readers.merge_bindings(rows).select("cik", "wikidata_id", F.array_join("websites", ",").alias("websites"))


@register("s32_dump_sources", "SELECT platform, source_key AS key, min(seq) AS first FROM v_postings GROUP BY 1, 2")
def s32(s, d):
    rows = view(s, d, "v_postings").select("platform", F.col("source_key").alias("key"), "company", F.col("seq").alias("_seq"))
    return readers.dump_sources(rows).select("platform", "key", "first")


@register("s33_record_lines", f"SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN day(day) % 5 <> 0 THEN postings ELSE -1 END AS postings, sources, status FROM ({_DAYS})")
def s33(s, d):
    shown = F.when(F.day("day") % 5 == 0, "?").otherwise(F.col("postings").cast("string"))
    lines = _days(s, d).select(F.concat_ws(" ", F.date_format("day", "MM/dd/yy"), shown, F.col("sources").cast("string"), F.when(F.col("status") != "complete", F.col("status"))).alias("value"))
    return record.parse(lines).withColumns({"day": F.col("day").cast("string"), "postings": F.coalesce("postings", F.lit(-1))})


@register("w06_one_per_day", "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CASE WHEN bool_or(event_type <> 'error') THEN 'complete' ELSE 'partial' END AS status FROM events GROUP BY 1")
def w06(s, d):
    rows = _table(s, d, "events").select(F.to_date("ts").alias("day"), F.lit(1).alias("postings"), F.lit(1).alias("sources"), F.when(F.col("event_type") == "error", "partial").otherwise("complete").alias("status"))
    return record.one_per_day(rows).select(F.col("day").cast("string").alias("day"), "status")


@register("g06_window", "SELECT min(first_s) AS started_at, max(last_s) AS finished_at, max(duration_ms) AS budget_ms FROM v_runs")
def g06(s, d):
    rows = _runs(s, d).select(F.col("first_s").alias("started_at"), F.col("last_s").alias("finished_at"), F.col("duration_ms").alias("budget_ms"))
    return shards.window(rows)


@register("c19_relabel", "SELECT key, CASE WHEN CAST(key AS BIGINT) % 2 = 0 AND CAST(key AS BIGINT) % 3 = 0 THEN 'deferred' WHEN CAST(key AS BIGINT) % 2 = 0 THEN 'planned' ELSE 'complete' END AS status FROM (SELECT DISTINCT key FROM v_runs)")
def c19(s, d):
    k = F.col("key").cast("long")
    rows = _runs(s, d).select("platform", "key").distinct().withColumn("status", F.when(k % 2 == 0, "planned").otherwise("complete"))
    return schedule.relabel(rows, rows.filter(k % 3 == 0)).select("key", "status")


@register("e07_examples", f"SELECT 'p/' || a.src AS a, 'p/' || b.src AS b, array_to_string(list_slice(list_sort(list(DISTINCT a.v)), 1, 3), ',') AS examples FROM ({_EVID}) a JOIN ({_EVID}) b ON a.v = b.v WHERE 'p/' || CAST(a.src AS STRING) < 'p/' || CAST(b.src AS STRING) GROUP BY 1, 2")
def e07(s, d):
    facts = cut(_facts(s, d), "facts")
    pairs = resolve.overlaps(facts).select("a", "b")
    return resolve.examples(facts, pairs).select("a", "b", F.array_join("examples", ",").alias("examples"))


@register("e08_probe", "SELECT seq, tie FROM v_postings WHERE platform || '/' || source_key IN ('asia/2', 'asia/7', 'europe/3')")
def e08(s, d):
    return resolve.probe(typed_postings(s, d), [("asia", "2"), ("asia", "7"), ("europe", "3")]).select("seq", "tie")


@register("p28_projection", "SELECT company, title, platform, source_key, count(*) AS n FROM v_postings GROUP BY ALL")
def p28(s, d):
    return typed_postings(s, d).groupBy("company", "title", "platform", "source_key").agg(F.count("*").alias("n"))


@register("p29_flatten", "SELECT seq, tie, company FROM v_postings")
def p29(s, d):
    return employers.flatten(employers.attach(typed_postings(s, d), _employers(s, d))).select("seq", "tie", "company")


@register("o08_browser_page", "SELECT seq, tie FROM v_postings WHERE contains(lower(title), 'rod') ORDER BY company, title, seq, tie LIMIT 100 OFFSET 0")
def o08(s, d):
    limit, offset = search.clamp_page(400, -5)
    return search.page(Query(titles=("rod",)).apply(typed_postings(s, d)), [F.col(x) for x in ("company", "title", "seq", "tie")], limit, offset).select("seq", "tie")


@register("o14_last_samples", "SELECT key, array_to_string(list_slice(a, greatest(len(a) - 6, 1), len(a)), ',') AS kept FROM (SELECT key, list(postings ORDER BY day) AS a FROM v_runs GROUP BY 1)")
def o14(s, d):
    rows = _runs(s, d).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "postings"))), lambda x: x["postings"]).alias("a"))
    init = F.slice("a", 1, F.size("a") - 1)
    kept = schedule.push_sample(init, F.element_at("a", -1))
    return rows.select("key", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("kept"))


@register("l04_last_seen", "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'closed' WHEN user_id % 3 = 1 THEN 'row' ELSE 'source' END AS came_from FROM (SELECT DISTINCT user_id FROM events)")
def l04(s, d):
    m, ts = F.col("user_id") % 3, lambda x: F.lit(instant(x))
    closed = F.when(m == 0, F.struct(ts("2020-01-01T00:00:00").alias("last_seen")))
    seen = corpus.last_seen(F.when(m < 2, ts("2021-01-01T00:00:00")), closed, ts("2022-01-01T00:00:00"))
    rows = _table(s, d, "events").select("user_id").distinct()
    return rows.select("user_id", F.element_at(F.array(F.lit("closed"), F.lit("row"), F.lit("source")), F.year(seen) - 2019).alias("came_from"))


@register("k07_pay_label", "SELECT p_partkey, 'USD ' || CAST(p_size AS STRING) || '-' || CAST(p_size + 5 AS STRING) || '/hour' AS label FROM part")
def k07(s, d):
    size = F.col("p_size").cast("double")
    return _table(s, d, "part").select("p_partkey", pay.label(size, size + 5, F.lit("USD"), F.lit("hour"), F.lit("")).alias("label"))


@register("t02_union_distinct", "SELECT count(*) AS n FROM (SELECT DISTINCT CASE WHEN url <> '' THEN url ELSE company || chr(0) || title || chr(0) || location END FROM v_postings)")
def t02(s, d):
    rows = typed_postings(s, d)
    return dedupe.dedupe(rows.unionByName(rows), ["seq", "tie"]).agg(F.count("*").alias("n"))
