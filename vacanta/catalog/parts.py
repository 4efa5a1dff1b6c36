"""Queries of single functions, orders, checks, readers and writers over whole tables."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import dates, hashes, names, pay, text, urls
from ..functions.paytext import description_pay_udf, salary_pay_udf, text_pay_udf
from ..operators import corpus, employers, registry, resolve, schedule, search, shards, sinks
from ..operators.storage import at_end, shared_dir
from ..plans.query import Query, check_scope, parse_age, parse_posted_since, tool_recency
from ..schema import MANIFEST, SCHED_GROUPS, SCHED_SOURCES
from ..sources import facets, readers
from .more import _table
from .queries import EMPLOYMENT, KEY, WORKPLACE, _ENOUGH, _EVID, _LINES, _SCHED, _SHARED, _STATE, _employers, _facts, _line_facts, _runs, _sched, _sched_state, instant, register, staged
from .views import typed_postings, view


def folder(s, name: str) -> str:
    """A new path in the shared folder, gone when the driver ends."""
    return at_end(s, f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}")


def tells(call, *args) -> bool:
    """Whether a check refuses its arguments."""
    try:
        call(*args)
        return False
    except ValueError:
        return True


# ------------------------------------------------------------------ orders and pages


@register("o01_corpus_order", "SELECT seq, tie FROM v_postings ORDER BY platform, source_key, seq, tie LIMIT 200")
def o01(s, d):
    rows = view(s, d, "v_postings").withColumn("id", F.col("seq"))
    return search.page(rows, [*search.ORDERS["corpus"](), F.col("tie")], 200).select("seq", "tie")


@register("o02_newest_first", "SELECT seq, tie FROM v_postings ORDER BY posted_at DESC NULLS LAST, company, title, seq, tie LIMIT 200 OFFSET 50")
def o02(s, d):
    rows = view(s, d, "v_postings").withColumn("first_seen", F.lit(None).cast("timestamp"))
    return search.page(rows, [*search.ORDERS["newest"](), F.col("seq"), F.col("tie")], 200, 50).select("seq", "tie")


@register("o04_source_order", "SELECT company, platform, key FROM v_sources ORDER BY lower(company), platform, key LIMIT 70 OFFSET 5")
def o04(s, d):
    rows = view(s, d, "v_sources").withColumn("source_key", F.col("key"))
    return search.page(rows, search.ORDERS["sources"](), 70, 5).select("company", "platform", "key")


@register("o06_health_order", "SELECT st AS status, company, key, CAST(day AS STRING) AS day FROM (SELECT *, CASE WHEN errors > 0 THEN 'failing' WHEN postings = 0 THEN 'empty' ELSE 'ok' END AS st FROM v_runs) x ORDER BY st, lower(company), day LIMIT 150")
def o06(s, d):
    rows = registry.health(_runs(s, d))
    return search.page(rows, [*search.ORDERS["health"](), F.col("day")], 150).select("status", "company", "key", F.col("day").cast("string").alias("day"))


@register("o09_tool_limits", "SELECT * FROM (VALUES (0, 50), (-3, 50), (7, 7), (500, 500), (501, 500)) t(asked, given)")
def o09(s, d):
    return s.createDataFrame([(n, search.clamp_tool(n)) for n in (0, -3, 7, 500, 501)], "asked int, given int")


@register("o10_company_list", "SELECT lower(company) AS folded, arg_min(company, reg_idx) AS company FROM v_sources GROUP BY 1 ORDER BY 1 LIMIT 100 OFFSET 10")
def o10(s, d):
    limit = search.clamp_tool(0, search.LIST_DEFAULT, search.LIST_MOST)
    return search.page(registry.companies(view(s, d, "v_sources")), [F.col("folded")], limit, 10)


@register("o10_past_the_end", "SELECT company FROM v_sources WHERE false")
def o10_end(s, d):
    return search.page(registry.companies(view(s, d, "v_sources")), [F.col("folded")], 100, 1 << 30).select("company")


_MATCHES = "FROM v_sources s LEFT JOIN v_employers e ON lower(s.platform) = lower(e.platform) AND lower(s.key) = lower(e.key) WHERE contains(lower(s.company), 'company 1') OR contains(lower(s.key), 'company 1') OR contains(lower(s.company), '7') OR contains(lower(s.key), '7')"


@register("e09_employer_lookup", f"SELECT s.platform, s.key, s.company, e.legal_name {_MATCHES} ORDER BY lower(s.company), s.platform, s.key LIMIT 50")
def e09(s, d):
    found = employers.lookup(view(s, d, "v_sources"), _employers(s, d), ["Company 1", "7"])
    return found.rows.select("platform", "key", "company", F.col("employer.legal_name").alias("legal_name"))


@register("o11_known_of_all", f"SELECT count(*) AS matched, count(e.key) AS known {_MATCHES}")
def o11(s, d):
    return employers.lookup(view(s, d, "v_sources"), _employers(s, d), ["Company 1", "7"], 5).counts


@register("p16_browser_states", f"SELECT count(*) FILTER (WHERE st IN ('open', 'stale')) AS shown, count(*) AS with_closed FROM (SELECT {_STATE} AS st FROM v_postings)")
def p16(s, d):
    rows, state = staged(s, d), F.col("state")
    return rows.agg(F.count_if(state.isin(search.browser_states())).alias("shown"), F.count_if(state.isin(search.browser_states(True))).alias("with_closed"))


@register("p27_refused_scopes", "SELECT * FROM (VALUES ('none', true), ('blank', true), ('unknown', true), ('many', true), ('some', false)) t(asked, refused)")
def p27(s, d):
    rows = view(s, d, "v_sources")
    asked = {"none": ([],), "blank": ([" "],), "unknown": (["no such company"],), "many": (["company"], 2), "some": (["company 1"], 1 << 30)}
    return s.createDataFrame([(k, tells(check_scope, rows, *v)) for k, v in asked.items()], "asked string, refused boolean")


@register("p13_filter_in_pieces", "SELECT seq, tie FROM v_postings WHERE contains(lower(title), 'ring')")
def p13(s, d):
    rows, query = typed_postings(s, d), Query(titles=("ring",))
    odd = query.apply(rows.filter("seq % 2 = 1"))
    return odd.unionByName(query.apply(rows.filter("seq % 2 = 0"))).select("seq", "tie")


_FINDINGS = _SHARED(_EVID)


@register("g24_pair_counts", f"SELECT count(*) AS pairs, CAST(sum(shared) AS BIGINT) AS shared FROM ({_FINDINGS})")
def g24(s, d):
    return resolve.overlaps(_facts(s, d)).filter("kind = 'req'").agg(F.count("*").alias("pairs"), F.sum("shared").alias("shared"))


@register("e06_strength", f"SELECT a, b, round(shared / greatest(na, nb), 9) AS strength FROM ({_FINDINGS})")
def e06(s, d):
    pairs = resolve.overlaps(_facts(s, d))
    return pairs.select("a", "b", F.round(F.col("shared") / F.greatest("size_a", "size_b"), 9).alias("strength"))


@register("o15_findings_order", f"SELECT a, b FROM ({_FINDINGS}) ORDER BY CAST(a[3:4] = b[3:4] AS INT), shared / greatest(na, nb) DESC, a, b LIMIT 100")
def o15(s, d):
    pairs = resolve.overlaps(_facts(s, d)).withColumn("strength", F.col("shared") / F.greatest("size_a", "size_b"))
    named = pairs.withColumns({"name_a": F.substring("a", 3, 2), "name_b": F.upper(F.substring("b", 3, 2))})
    return resolve.ordered(named).limit(100).select("a", "b")


@register("e03_evidence_kinds", "SELECT kind, count(*) AS n FROM (SELECT DISTINCT platform, source_key, kind, v FROM (SELECT platform, source_key, unnest([{'k': 'raw', 'v': url}, {'k': 'url', 'v': url}, {'k': 'req', 'v': CASE WHEN length(requisition_id) >= 4 THEN requisition_id ELSE '' END}]) AS e FROM v_postings), LATERAL (SELECT e.k AS kind, e.v AS v) WHERE v <> '') GROUP BY 1")
def e03(s, d):
    rows = typed_postings(s, d).select("platform", "key", "url", F.col("requisition_id").alias("req"))
    return resolve.evidence(rows).groupBy("kind").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ names and hosts

_WORDS = "SELECT p_partkey AS k, p_name || ' & ' || p_brand AS raw FROM part"


@register("f06_squash", f"SELECT k, regexp_replace(replace(lower(raw), '&', ' and '), '[^a-z0-9]+', '', 'g') AS squashed FROM ({_WORDS})")
def f06(s, d):
    raw = F.concat_ws(" & ", "p_name", "p_brand")
    return _table(s, d, "part").select(F.col("p_partkey").alias("k"), names.squashed(raw).alias("squashed"))


_NAMES = "SELECT DISTINCT event_type AS name FROM events UNION SELECT DISTINCT lang FROM documents UNION SELECT DISTINCT lower(n_name) FROM nation UNION SELECT DISTINCT p_type FROM part"


@register("f08_distinctive", f"SELECT name, contains(name, ' ') OR strlen(name) >= 5 AS distinctive FROM ({_NAMES})")
def f08(s, d):
    cols = (("events", "event_type"), ("documents", "lang"), ("nation", F.lower("n_name")), ("part", "p_type"))
    rows = [_table(s, d, t).select((F.col(c) if isinstance(c, str) else c).alias("name")) for t, c in cols]
    found = rows[0].union(rows[1]).union(rows[2]).union(rows[3]).distinct()
    return found.select("name", names.distinctive(F.col("name")).alias("distinctive"))


@register("f11_pad_cik", "SELECT c_custkey, lpad(CAST(c_custkey AS STRING), 10, '0') AS cik FROM customer")
def f11(s, d):
    raw = F.concat(F.when(F.col("c_custkey") % 2 == 0, "CIK").otherwise(" "), F.col("c_custkey").cast("string"))
    return _table(s, d, "customer").select("c_custkey", names.pad_cik(raw).alias("cik"))


@register("f28_source_host", "SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), ':[0-9]+$', ''), '') AS host FROM pages")
def f28(s, d):
    return _table(s, d, "pages").select("page_id", urls.source_host(F.col("url")).alias("host"))


_HOSTED = "SELECT platform, CASE WHEN platform = 'asia' THEN 't' || key || '.breezy.hr' WHEN platform = 'europe' AND reg_idx % 2 = 0 THEN key || '.greenhouse.io' ELSE key END AS key FROM v_sources"


def _hosted(s, d):
    c = F.col
    key = F.when(c("platform") == "asia", F.concat(F.lit("t"), "key", F.lit(".breezy.hr"))).when((c("platform") == "europe") & (c("reg_idx") % 2 == 0), F.concat("key", F.lit(".greenhouse.io")))
    return view(s, d, "v_sources").withColumn("key", F.coalesce(key, "key"))


@register("f29_affinity", f"SELECT platform, key, CASE WHEN platform = 'asia' THEN 'service:breezy.hr' ELSE 'platform:' || platform END AS \"group\" FROM ({_HOSTED})")
def f29(s, d):
    return shards.affinity(_hosted(s, d)).select("platform", "key", "group")


@register("f27_evidence_hash", "SELECT count(DISTINCT user_id) * count(DISTINCT event_type) AS made, count(DISTINCT user_id) * count(DISTINCT event_type) AS distinct_hashes FROM events")
def f27(s, d):
    rows = _table(s, d, "events")
    kinds = F.broadcast(rows.select("event_type").distinct())  # a handful
    every = rows.select("user_id").distinct().crossJoin(kinds).select(hashes.evidence_hash(F.col("event_type"), F.col("user_id").cast("string")).alias("h"))
    return every.agg(F.count("*").alias("made"), F.countDistinct("h").alias("distinct_hashes"))


# ------------------------------------------------------------------ fields of payloads


@register("f12_facet", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS picked FROM part")
def f12(s, d):
    pair = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    found = F.array(pair("Work type area", F.col("p_name")), pair("TYPE of work", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")), pair("brand", F.col("p_brand")))
    return _table(s, d, "part").select("p_partkey", text.facet(found, ["type", "Brand"], ["area"]).alias("picked"))


@register("f16_unlabelled_type", f"SELECT seq, tie, {EMPLOYMENT} AS kind FROM v_postings")
def f16(s, d):
    rows = view(s, d, "v_postings")
    return rows.select("seq", "tie", text.unlabelled_employment(F.array(F.lit("Berlin"), F.lit(""), F.col("employment_raw"))).alias("kind"))


@register("f17_two_fields", f"SELECT seq, tie, coalesce({EMPLOYMENT}, CASE seq % 3 WHEN 1 THEN 'full_time' WHEN 2 THEN 'part_time' END) AS kind FROM v_postings")
def f17(s, d):
    rows, m = view(s, d, "v_postings"), F.col("seq") % 3
    hours = F.when(m == 0, "Full-time or part-time").when(m == 1, "Full time").otherwise("Part-Time")
    return rows.select("seq", "tie", text.two_field_employment(F.col("employment_raw"), hours).alias("kind"))


@register("f18_search_name", "SELECT p_partkey, substr(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name || ' ' || p_type || ' ' || p_brand, 1, 60) AS name FROM part")
def f18(s, d):
    once = F.concat_ws("  \t ", "p_name", "p_type", "p_brand")
    return _table(s, d, "part").select("p_partkey", text.search_name(F.concat(F.lit("  "), once, F.lit(" \n "), once, F.lit("  "))).alias("name"))


@register("f19_since_label", "SELECT DISTINCT CAST(ts AS STRING)[1:10] AS day, CASE date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS STRING) || ' days ago' END AS label FROM events")
def f19(s, d):
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    return _table(s, d, "events").select(F.to_date("ts").cast("string").alias("day"), dates.since_label(age).alias("label")).distinct()


@register("f43_most_trusted", "SELECT l_orderkey AS k, min(l_linenumber % 4) AS rank FROM lineitem GROUP BY 1")
def f43(s, d):
    rows, n = _table(s, d, "lineitem"), F.col("l_linenumber") % 4
    named = F.element_at(F.array(*map(F.lit, ("employer", "structured", "description", "a rumour"))), n.cast("int") + 1)
    best = rows.groupBy(F.col("l_orderkey").alias("k")).agg(F.max(pay.trust(named)).alias("most"))
    return best.select("k", (F.lit(3) - F.col("most")).alias("rank"))


_PERIODS = [("hourly", "hour"), ("per-year-salary", "year"), ("1 month", "month"), ("WEEK", "week"), ("Annually", "year"), ("a while", None), (" Daily ", "day")]


@register("f48_period_words", "SELECT p_partkey, CASE p_size % 7 " + " ".join(f"WHEN {i} THEN {repr(p) if p else 'NULL'}" for i, (_, p) in enumerate(_PERIODS)) + " END AS period FROM part")
def f48(s, d):
    raw = F.element_at(F.array(*[F.lit(w) for w, _ in _PERIODS]), F.col("p_size") % 7 + 1)
    return _table(s, d, "part").select("p_partkey", pay.period_of(raw).alias("period"))


@register("f49_pay_builder", "SELECT seq, tie, CASE WHEN pay_min > 0 OR pay_max > 0 THEN CASE WHEN pay_min > 0 THEN pay_min ELSE pay_max END END AS low, CASE WHEN pay_min > 0 OR pay_max > 0 THEN CASE WHEN pay_max > 0 THEN pay_max ELSE pay_min END END AS high FROM v_postings")
def f49(s, d):
    c = F.col
    made = pay.build(c("pay_min"), c("pay_max"), F.lit("USD"), F.lit("yearly"), F.lit(""), "employer")
    return view(s, d, "v_postings").select("seq", "tie", made["min"].alias("low"), made["max"].alias("high"))


@register("f44_pay_from_text", "SELECT p_partkey, CAST(p_size * 1500 + 20000 AS DOUBLE) AS low, CAST(p_size * 2500 + 20000 AS DOUBLE) AS high, 'year' AS period FROM part")
def f44(s, d):
    size = F.col("p_size")
    words = F.format_string("We pay well. Base salary range: $%d - $%d per year. <b>401(k)</b> match.", size * 1500 + 20000, size * 2500 + 20000)
    return _table(s, d, "part").select("p_partkey", text_pay_udf(words).alias("pay")).select("p_partkey", F.col("pay.min").alias("low"), F.col("pay.max").alias("high"), "pay.period")


@register("f45_open_ended_pay", "SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size + 20 END AS DOUBLE) AS low, CAST(CASE WHEN p_size % 2 = 0 THEN p_size + 20 ELSE 0 END AS DOUBLE) AS high, 'EUR' AS currency FROM part")
def f45(s, d):
    size = F.col("p_size")
    words = F.when(size % 2 == 0, F.format_string("Hourly rate: up to EUR %d per hour", size + 20)).otherwise(F.format_string("Hourly rate: starting at EUR %d per hour", size + 20))
    return _table(s, d, "part").select("p_partkey", text_pay_udf(words).alias("pay")).select("p_partkey", F.col("pay.min").alias("low"), F.col("pay.max").alias("high"), "pay.currency")


@register("f47_pay_from_markup", "SELECT p_partkey, CAST(p_size * 1000 + 30000 AS DOUBLE) AS low, CAST(p_size * 2000 + 30000 AS DOUBLE) AS high, 'structured' AS provenance FROM part")
def f47(s, d):
    size = F.col("p_size")
    words = F.format_string('<p>x</p><div class="pay-range"><span>$%d</span>&mdash;<span>$%d USD</span></div>', size * 1000 + 30000, size * 2000 + 30000)
    return _table(s, d, "part").select("p_partkey", description_pay_udf(words).alias("pay")).select("p_partkey", F.col("pay.min").alias("low"), F.col("pay.max").alias("high"), "pay.provenance")


@register("f50_salary_field", "SELECT p_partkey, CAST(p_size + 20 AS DOUBLE) AS low, CAST(p_size + 45 AS DOUBLE) AS high, 'hour' AS period, 'employer' AS provenance FROM part")
def f50(s, d):
    words = F.format_string("$%d - $%d / hr", F.col("p_size") + 20, F.col("p_size") + 45)
    return _table(s, d, "part").select("p_partkey", salary_pay_udf(words).alias("pay")).select("p_partkey", F.col("pay.min").alias("low"), F.col("pay.max").alias("high"), "pay.period", "pay.provenance")


@register("f52_axis_step", "SELECT DISTINCT p_size AS span, CASE WHEN p_size / 5.0 <= lead * 1 THEN lead WHEN p_size / 5.0 <= lead * 2 THEN lead * 2 WHEN p_size / 5.0 <= lead * 2.5 THEN lead * 2.5 WHEN p_size / 5.0 <= lead * 5 THEN lead * 5 ELSE lead * 10 END AS step FROM (SELECT p_size, CASE WHEN p_size < 5 THEN 0.1 WHEN p_size < 50 THEN 1.0 ELSE 10.0 END::DOUBLE AS lead FROM part)")
def f52(s, d):
    span = F.col("p_size").cast("double")
    return _table(s, d, "part").select(F.col("p_size").alias("span"), F.round(pay.axis_step(span), 6).alias("step")).distinct()


@register("f64_first_layout", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def f64(s, d):
    at, m = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 4
    raw = F.when(m == 0, F.date_format(at, "yyyy-MM-dd")).when(m == 1, F.date_format(at, "MMMM d, yyyy")).when(m == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.concat(F.lit(" "), F.date_format(at, "yyyy-MM-dd HH:mm:ss")))
    return _table(s, d, "orders").select("o_orderkey", F.date_format(dates.first_layout(raw), "yyyy-MM-dd").alias("day"))


_AGES = [("3d", 259_200), ("1.5w", 907_200), ("1h30m", 5_400), ("90s", 90), ("2d", 172_800), ("500ms", 0.5)]


@register("f61_ages", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {float(n)}::DOUBLE)" for a, n in _AGES) + ") t(age, seconds)")
def f61(s, d):
    return s.createDataFrame([(a, parse_age(a).total_seconds()) for a, _ in _AGES], "age string, seconds double")


@register("f62_tool_recency", "SELECT count(*) FILTER (WHERE posted_at >= TIMESTAMP '2001-01-01 00:00:00' - INTERVAL 400 DAY) AS within, count(*) FILTER (WHERE posted_at >= TIMESTAMP '2000-03-01 00:00:00') AS since, true AS both_refused FROM v_postings")
def f62(s, d):
    now, rows = instant("2001-01-01T00:00:00"), typed_postings(s, d)
    of = lambda *a: F.count_if(F.col("posted_at") >= F.lit(tool_recency(*a, now)))
    return rows.agg(of(None, 400).alias("within"), of("2000-03-01", None).alias("since")).withColumn("both_refused", F.lit(tells(tool_recency, "3d", 5, now) and tells(parse_posted_since, "-3d", now)))


# ------------------------------------------------------------------ shards and schedules


def _plan(s, d):
    return shards.plan(view(s, d, "v_sources"), 4)


@register("c02_costs", "SELECT key, CASE WHEN n >= 20 THEN n * 10 ELSE 77 END AS cost FROM (SELECT key, count(*) AS n FROM v_runs GROUP BY 1)")
def c02(s, d):
    runs = _runs(s, d).groupBy("platform", "key").agg(F.count("*").alias("n"))
    made = shards.plan(runs, 1, runs.filter("n >= 20").select("platform", "key", (F.col("n") * 10).alias("cost")), 77)
    total = made.shards[0]["estimated_ms"]
    costs = runs.select("key", F.when(F.col("n") >= 20, F.col("n") * 10).otherwise(77).alias("cost"))
    if costs.agg(F.sum("cost")).first()[0] != total:
        raise ValueError("the plan's shard doesn't hold the costs of its sources")
    return costs


@register("c01_all_in_one_shard", "SELECT platform, key FROM v_sources ORDER BY platform, key")
def c01_all(s, d):
    made = _plan(s, d)
    return s.createDataFrame([x for shard in made.shards for x in shard["sources"]], "platform string, key string")


@register("c01_group_stays_together", "SELECT DISTINCT platform, CAST(1 AS BIGINT) AS shards FROM v_sources")
def c01_groups(s, d):
    rows = [(x["index"], p) for x in _plan(s, d).shards for p, _ in x["sources"]]
    return s.createDataFrame(rows, "shard int, platform string").groupBy("platform").agg(F.countDistinct("shard").alias("shards"))


@register("s26_plan_file", "SELECT platform, key FROM v_sources")
def s26(s, d):
    made, path = _plan(s, d), folder(s, "plan") + ".json"
    shards.write_plan(s, at_end(s, path), made)
    found = shards.read_plan(s, path)
    if found != made:
        raise ValueError("the plan read isn't the one written")
    return s.createDataFrame([x for shard in found.shards for x in shard["sources"]], "platform string, key string")


@register("k13_matrix", "SELECT unnest([0, 1, 2, 3]) AS shard")
def k13(s, d):
    return s.createDataFrame([(i,) for i in shards.write_plan(s, folder(s, "plan"), _plan(s, d))], "shard int")


@register("c03_plan_checks", "SELECT * FROM (VALUES ('as made', false), ('version', true), ('index', true), ('twice', true), ('changed', true)) t(plan, refused)")
def c03(s, d):
    out = []
    for name in ("as made", "version", "index", "twice", "changed"):
        made = _plan(s, d)
        if name == "version":
            made.schema_version += 1
        elif name == "index":
            made.shards[0]["index"] = 3
        elif name == "twice":
            made.shards[0]["sources"].append(made.shards[0]["sources"][0])
        elif name == "changed":
            made.plan_id = made.plan_id[::-1]
        out.append((name, tells(made.validate)))
    return s.createDataFrame(out, "plan string, refused boolean")


@register("c04_source_set_checks", "SELECT * FROM (VALUES ('same', false), ('one more', true)) t(registry, refused)")
def c04(s, d):
    made = _plan(s, d)
    own = [x for shard in made.shards for x in shard["sources"]]
    return s.createDataFrame([("same", tells(made.check_sources, own[::-1])), ("one more", tells(made.check_sources, [*own, ("new", "one")]))], "registry string, refused boolean")


@register("c06_stamp_errors", "SELECT * FROM (VALUES (0, NULL), (1, 'plan'), (2, 'count'), (3, 'schema-version')) t(shard, error)")
def c06(s, d):
    made = _plan(s, d)
    stamp = lambda i, **other: tuple(({"index": i, "count": 4, "plan_id": made.plan_id, "source_set_id": made.source_set_id, "commit": ""} | other).values())
    rows = [(0, 2, stamp(0)), (1, 2, stamp(1, plan_id="other")), (2, 2, stamp(2, count=5)), (3, 1, stamp(3))]
    frame = s.createDataFrame(rows, "shard int, schema_version int, stamp struct<index:int,count:int,plan_id:string,source_set_id:string,commit:string>")
    return shards.stamp_errors(frame, made)


@register("c07_index_errors", "SELECT shard, CASE WHEN shard > 3 THEN 'out-of-range' ELSE 'twice' END AS error FROM (SELECT DISTINCT CAST(user_id % 6 AS INT) AS shard, user_id FROM events) GROUP BY shard HAVING shard > 3 OR count(DISTINCT user_id) > 1 UNION ALL SELECT m, 'missing' FROM (SELECT unnest([0, 1, 2, 3]) AS m) WHERE m NOT IN (SELECT user_id % 6 FROM events)")
def c07(s, d):
    rows = _runs(s, d).select("key").distinct().select((F.col("key").cast("long") % 6).cast("int").alias("shard"))
    return shards.index_errors(rows, 4)


_MERGED = "SELECT count(*) AS postings, count(DISTINCT company) AS companies FROM (SELECT company FROM v_postings QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY seq % 4, seq, tie) = 1)"


def _merge(s, d, failed: int = 0, **how):
    """The postings as four shards' streams, with the manifests of a plan of their sources."""
    rows = typed_postings(s, d)
    made = shards.plan(rows.select("platform", "key").distinct(), 4)
    planned = [(x["index"], p, k) for x in made.shards for p, k in x["sources"]]
    of = s.createDataFrame(planned, "shard int, platform string, key string")
    c = F.col
    keys = rows.join(of, ["platform", "key"]).select("shard", (c("seq") * 1000 + F.char_length("tie")).alias("line"), hashes.dedupe_key(c("url"), c("company"), c("title"), c("location")).alias("key"), "company", "platform")
    counts = {r["shard"]: r["n"] for r in keys.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    stamp = (4, made.plan_id, made.source_set_id, "")
    manifests = s.createDataFrame([(i, 2, (i, *stamp), "complete", counts.get(i, 0)) for i in range(4)], "shard int, schema_version int, stamp struct<index:int,count:int,plan_id:string,source_set_id:string,commit:string>, status string, postings long")
    runs = of.withColumn("status", F.when(F.pmod(F.col("key").cast("int"), F.lit(10)) < failed, "failed").otherwise("complete"))
    return shards.merge(made, manifests, runs, keys, **how)


@register("c05_merged_totals", _MERGED.format(key=KEY))
def c05_merged(s, d):
    got = _merge(s, d)
    return s.createDataFrame([(got["postings"], got["companies"])], "postings long, companies long")


@register("c09_failure_gate", "SELECT * FROM (VALUES ('a tenth', false, 'complete'), ('a third', true, ''), ('a third, allowed', false, 'partial'), ('a third, no gate', false, 'complete')) t(failed, refused, status)")
def c09(s, d):
    out = []
    for name, n, how in (("a tenth", 1, {}), ("a third", 4, {}), ("a third, allowed", 4, {"allow_partial": True}), ("a third, no gate", 4, {"max_failed": -1.0})):
        try:
            out.append((name, False, _merge(s, d, n, **how)["status"]))
        except ValueError:
            out.append((name, True, ""))
    return s.createDataFrame(out, "failed string, refused boolean, status string")


@register("j12_planned_sources", "SELECT platform, key, company FROM v_sources WHERE reg_idx % 3 = 0")
def j12(s, d):
    rows = view(s, d, "v_sources")
    planned = rows.filter("reg_idx % 3 = 0").select("platform", "key", F.col("reg_idx").alias("rank"))
    return shards.resolve_sources(planned, rows).select("platform", "key", "company")


@register("j12_missing_refused", "SELECT true AS refused")
def j12_missing(s, d):
    rows = view(s, d, "v_sources")
    planned = rows.select("platform", "key", F.col("reg_idx").alias("rank"))
    return s.createDataFrame([(tells(shards.resolve_sources, planned, rows.filter("reg_idx % 3 = 0")),)], "refused boolean")


@register("c16_gate", f"SELECT key, fails * 60 <= 120 AS admitted FROM ({_SCHED})")
def c16(s, d):
    at = instant("2024-01-31T06:00:00")
    rows = _sched(s, d)
    known = [(n, schedule.gate(at, n * 60_000, at + timedelta(minutes=2))) for (n,) in rows.select("fails").distinct().collect()]  # as many as failures in a row
    verdicts = s.createDataFrame(known, "fails int, admitted boolean")
    return rows.join(F.broadcast(verdicts), "fails").select("key", "admitted")


@register("c18_fold_groups", "SELECT * FROM (VALUES ('a', 5000, 3), ('b', 7000, 9), ('c', 1000, 1)) t(key, parallelism_milli, samples)")
def c18(s, d):
    old = s.createDataFrame([("a", 4000, None, 1), ("b", 7000, None, 4)], SCHED_GROUPS)
    new = s.createDataFrame([("a", 5000, 2), ("b", 6000, 5), ("c", 1000, 1)], "group string, parallelism_milli long, samples long")
    return schedule.fold_groups(old, new, instant("2024-01-31T00:00:00")).select("key", "parallelism_milli", "samples")


@register("c18_fold_all", "SELECT key, CAST(CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS INT) AS consecutive_failures, CAST(key AS BIGINT) % 2 = 0 AS retired FROM (SELECT key, arg_max(status, day) AS status FROM v_runs GROUP BY 1)")
def c18_all(s, d):
    rows = _runs(s, d)
    last = rows.groupBy("platform", "key").agg(F.max_by(F.struct("company", "status", "duration_ms", "postings"), "day").alias("r")).select("platform", "key", "r.*", F.lit("").alias("error_class"))
    last = last.withColumns({"started_at": F.lit(None).cast("timestamp"), "finished_at": F.lit(None).cast("timestamp")})
    here = rows.filter(F.col("key").cast("long") % 2 == 1).select("platform", "key", F.lit("g").alias("group")).distinct()
    state, _ = schedule.fold_all(s.createDataFrame([], SCHED_SOURCES), s.createDataFrame([], SCHED_GROUPS), here, [last], instant("2024-01-31T00:00:00"))
    return state.select("key", "consecutive_failures", "retired")


@register("c20_plan_costs", "SELECT key, cost FROM (SELECT key, least(greatest(max(duration_ms), 1), 1800000) AS cost FROM v_runs GROUP BY 1) UNION ALL SELECT '', CAST(floor(quantile_cont(cost, 0.5)) AS BIGINT) FROM (SELECT least(greatest(max(duration_ms), 1), 1800000) AS cost FROM v_runs GROUP BY key)")
def c20(s, d):
    rows = _runs(s, d).groupBy("platform", "key").agg(schedule.clamp_cost(F.max("duration_ms")).alias("cost"))
    costs = schedule.plan_costs([r.asDict() for r in rows.collect()])  # a row for each source of a plan
    return s.createDataFrame([(k, int(v)) for (_, k), v in costs.items()], "key string, cost long")


@register("c10_lanes", "SELECT key, CASE WHEN stale >= 3000 THEN 'aging' ELSE 'value' END AS lane, fails <= 0 OR epoch_ms(TIMESTAMP '2024-01-31 06:00:00') - epoch_ms(tried) >= 86400000 * CAST(pow(2, least(fails, 6)) AS BIGINT) AS may FROM (SELECT *, CASE WHEN ok IS NULL THEN 4000 ELSE least((epoch_ms(TIMESTAMP '2024-01-31 06:00:00') - epoch_ms(ok)) * 1000 // 86400000, 4000) END AS stale FROM (" + _SCHED + "))")
def c10(s, d):
    registered, state = _sched_state(s, d)
    return schedule.scored(registered, state, instant("2024-01-31T06:20:00")).select("key", "lane", "may")


@register("c12_emit_order", "SELECT CAST(row_number() OVER (ORDER BY turn, load DESC, g) - 1 AS INT) AS rank, key FROM (SELECT key, g, load, row_number() OVER (PARTITION BY g ORDER BY cost DESC, key) AS turn FROM (SELECT key, CAST(key AS BIGINT) % 10 AS g, cost, sum(cost) OVER (PARTITION BY CAST(key AS BIGINT) % 10) AS load FROM (SELECT key, sum(duration_ms) AS cost FROM v_runs GROUP BY 1)))")
def c12(s, d):
    rows = _runs(s, d).groupBy("platform", "key").agg(F.sum("duration_ms").alias("cost"))
    each = [r.asDict() | {"group": str(int(r["key"]) % 10), "score": 1, "lane": "value", "may": True, "stale": 1, "last_attempt": None} for r in rows.collect()]  # a row for each source
    plan = schedule.admit(each, {}, schedule.SchedulePolicy(), None)
    return s.createDataFrame([(r["rank"], r["key"]) for r in plan.items], "rank int, key string")


@register("c11_all_that_fits", "SELECT key FROM (SELECT key, cost, sum(cost) OVER (PARTITION BY CAST(key AS BIGINT) % 10 ORDER BY key) AS run, sum(cost) OVER (PARTITION BY CAST(key AS BIGINT) % 10) AS load FROM (SELECT key, CAST(1000 AS BIGINT) AS cost FROM v_runs GROUP BY 1)) WHERE run <= 72000")
def c11_fits(s, d):
    rows = _runs(s, d).select("platform", "key").distinct()
    each = [r.asDict() | {"cost": 1000, "group": str(int(r["key"]) % 10), "score": 1, "lane": "value", "may": True, "stale": 1, "last_attempt": None} for r in rows.collect()]  # a row for each source
    plan = schedule.admit(each, {}, schedule.SchedulePolicy(), timedelta(seconds=20), workers=1_000)
    return s.createDataFrame([(r["key"],) for r in plan.items], "key string")


# ------------------------------------------------------------------ readers and writers


@register("s11_postings_file", "SELECT seq, company, title, location, url, source_key, coalesce(CAST(remote AS STRING), '') AS remote, coalesce(strftime(posted_at, '%Y-%m-%d'), '') AS day FROM v_postings")
def s11(s, d):
    path, rows = folder(s, "postings"), typed_postings(s, d)
    sinks.write_json(rows.withColumn("team", F.col("seq").cast("string")).drop("seq", "tie", "key", "platform", "source_key"), path)
    back = readers.postings(s, path)
    day = F.coalesce(F.date_format("posted_at", "yyyy-MM-dd"), F.lit(""))
    return back.select(F.col("team").cast("long").alias("seq"), "company", "title", "location", "url", F.col("source.key").alias("source_key"), F.coalesce(F.col("remote").cast("string"), F.lit("")).alias("remote"), day.alias("day"))


@register("k01_json_lines", "SELECT seq, tie, company, url, title, location, requisition_id FROM v_postings")
def k01(s, d):
    lines = sinks.json_lines(typed_postings(s, d))
    of = lambda f: F.get_json_object("value", f"$.{f}").alias(f)
    return lines.select(of("seq").cast("long").alias("seq"), *[of(x) for x in ("tie", "company", "url", "title", "location", "requisition_id")])


@register("s12_shard_keys", f"SELECT {KEY} AS key, company, platform FROM v_postings")
def s12(s, d):
    path = folder(s, "keys")
    sinks.shard_lines(typed_postings(s, d)).write.json(path)
    return readers.shard_keys(s, path)


@register("s13_manifest_runs", "SELECT key, company, status, postings, errors, duration_ms FROM v_runs")
def s13(s, d):
    path, rows = folder(s, "manifests"), _runs(s, d)
    each = F.struct("platform", "key", "company", "status", F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), "duration_ms", "postings", "errors", F.lit("").alias("error_class"))
    days = rows.groupBy("day").agg(F.collect_list(each).alias("sources"))  # one manifest a day, with a row for each source
    days.select(F.lit(2).alias("schema_version"), F.lit("complete").alias("status"), "sources").repartition(64).write.json(path)
    found = s.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)
    return readers.manifest_runs(readers.with_sources(found)).select("key", "company", "status", "postings", "errors", "duration_ms")


@register("s17_strings", "SELECT count(*) AS n, count(DISTINCT title) AS titles, count(*) FILTER (WHERE false) AS others FROM v_postings")
def s17(s, d):
    rows = view(s, d, "v_postings")
    found = readers.strings(rows, "title").agg(F.count("*").alias("n"), F.countDistinct("title").alias("titles"))
    return found.crossJoin(readers.strings(rows, "no_such_column").agg(F.count_if(F.col("no_such_column") != "").alias("others")))  # a row each


@register("s18_ints", "SELECT CAST(sum(seq) AS BIGINT) AS total, CAST(0 AS BIGINT) AS others FROM v_postings")
def s18(s, d):
    rows = view(s, d, "v_postings")
    return readers.ints(rows, "seq").agg(F.sum("seq").alias("total")).crossJoin(readers.ints(rows, "none").agg(F.sum("none").alias("others")))  # a row each


@register("s19_names_that_stay", "SELECT * FROM (VALUES ('postings.parquet', false), ('a/b', false), ('../a', true), ('/a', true), ('a/../../b', true), ('', true), ('a\\b', true)) t(name, refused)")
def s19(s, d):
    return s.createDataFrame([(n, tells(readers.safe_name, n)) for n in ("postings.parquet", "a/b", "../a", "/a", "a/../../b", "", "a\\b")], "name string, refused boolean")


def _employer_file(s, d, rows) -> str:
    path = folder(s, "employers")
    cells = {x: F.lit("") for x in employers.EMPLOYER_COLUMNS}
    cells |= {"platform": F.col("platform"), "key": F.col("key"), "legal_name": F.col("legal_name"), "industry": F.col("industry"), "sic": F.col("sic"), "public": F.col("public").cast("string"), "employees": F.nullif(F.col("employees"), F.lit(0)).cast("string"), "method": F.col("method")}
    sinks.write_tsv(rows.coalesce(1).select(*[c.alias(n) for n, c in cells.items()]), path)
    return path


@register("s21_employer_tsv", "SELECT platform, key, legal_name, sic FROM v_employers")
def s21(s, d):
    path = _employer_file(s, d, view(s, d, "v_employers").withColumn("method", F.lit("edgar")))
    return readers.tsv(s, path, employers.EMPLOYER_COLUMNS).select("platform", "key", "legal_name", "sic")


@register("s22_typed_cells", "SELECT key, public, employees FROM v_employers")
def s22(s, d):
    path = _employer_file(s, d, view(s, d, "v_employers").withColumn("method", F.lit("edgar")))
    return employers.load(s, path).select("source.key", "public", F.coalesce("employees", F.lit(0)).alias("employees"))


@register("s23_employers_with_overlay", "SELECT key, CASE WHEN CAST(key AS BIGINT) % 5 = 0 THEN 'manual' ELSE 'edgar' END AS method FROM v_employers WHERE CAST(key AS BIGINT) % 10 <> 0")
def s23(s, d):
    rows, k = view(s, d, "v_employers"), F.col("key").cast("long")
    generated = _employer_file(s, d, rows.withColumn("method", F.lit("edgar")))
    by_hand = _employer_file(s, d, rows.filter(k % 5 == 0).withColumn("method", F.when(k % 10 == 0, "refuted").otherwise("manual")))
    return employers.load(s, generated, by_hand).select("source.key", "match.method")


def _state_rows(s, d):
    state = _sched_state(s, d)[1]
    have = set(state.columns)
    return state.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHED_SOURCES.fields])


@register("s24_state_file", f"SELECT key, fails AS consecutive_failures FROM ({_SCHED})")
def s24(s, d):
    path = folder(s, "state")
    groups = s.createDataFrame([("g", 2000, None, 3)], SCHED_GROUPS)
    readers.state_lines(_state_rows(s, d), groups, "2024-01-31T00:00:00Z").coalesce(1).write.text(path)
    sources, _, skipped = readers.schedule_state(s, path)
    if skipped:
        raise ValueError("records of unknown kinds")
    return sources.select("key", "consecutive_failures")


@register("k14_state_lines", "SELECT 'header' AS kind, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'group', 1 UNION ALL SELECT 'source', count(DISTINCT key) FROM v_runs")
def k14(s, d):
    lines = readers.state_lines(_state_rows(s, d), s.createDataFrame([("g", 2000, None, 3)], SCHED_GROUPS), "2024-01-31T00:00:00Z")
    return lines.groupBy(F.get_json_object("value", "$.kind").alias("kind")).agg(F.count("*").alias("n"))


@register("s25_cold_start", "SELECT * FROM (VALUES ('damaged', 0), ('two headers', 0), ('whole', 1)) t(file, sources)")
def s25(s, d):
    head, row = '{"kind":"header","version":1}', '{"kind":"source","platform":"p","key":"k"}'
    out = []
    for name, lines in (("damaged", [head, '{"kind":"source","platform":']), ("two headers", [head, head, row]), ("whole", [head, row])):
        path = folder(s, "state")
        s.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
        out.append((name, readers.schedule_state_or_cold(s, path)[0].count()))
    return s.createDataFrame(out, "file string, sources int")


@register("s27_shard_folder", f"SELECT CAST(seq % 3 AS INT) AS shard, count(*) AS n, count(DISTINCT {KEY}) AS keys FROM v_postings GROUP BY 1")
def s27(s, d):
    path, rows = folder(s, "shards"), typed_postings(s, d)
    for i in range(3):
        part = f"{path}/part-{i}"
        sinks.shard_lines(rows.filter(F.col("seq") % 3 == i)).coalesce(1).write.json(part)
        readers.place_part(s, part, f"{path}/shard-{i}.ndjson")
        corpus.write_text(s, f"{path}/shard-{i}.json", '{"schema_version": 2, "status": "complete", "sources": []}')
    manifests, keys = readers.merge_dir(s, path, 3)
    if manifests.count() != 3:
        raise ValueError("a manifest is missing")
    return keys.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@register("s29_filers_by_cik", "SELECT user_id AS cik, min(event_type) AS wikidata_id FROM events WHERE user_id % 2 = 0 GROUP BY 1")
def s29(s, d):
    rows = _table(s, d, "events")
    wanted = rows.filter("user_id % 2 = 0").select(F.col("user_id").alias("cik")).distinct()
    facts = rows.select(F.col("user_id").alias("cik"), F.col("event_type").alias("wikidata_id"), F.lit("").alias("parent"), F.lit("").alias("website"))
    return readers.look_up(wanted, facts).select("cik", "wikidata_id")


@register("s31_websites_by_cik", "SELECT user_id AS cik, array_to_string(list_sort(list(DISTINCT event_type || '.com')), ' ') AS websites FROM events GROUP BY 1")
def s31(s, d):
    rows = _table(s, d, "events")
    facts = rows.select(F.col("user_id").alias("cik"), F.lit("").alias("wikidata_id"), F.lit("").alias("parent"), F.concat("event_type", F.lit(".com")).alias("website"))
    return readers.look_up(rows.select(F.col("user_id").alias("cik")).distinct(), facts).select("cik", F.array_join("websites", " ").alias("websites"))


_FACETS = "SELECT event_type AS category, CAST(user_id % 7 AS STRING) AS country, count(*) AS n FROM events GROUP BY ALL"


def _facet_counts(s, d):
    return _table(s, d, "events").groupBy(F.col("event_type").alias("category"), (F.col("user_id") % 7).cast("string").alias("country")).agg(F.count("*").alias("n"))


@register("s35_facet_slices", f"SELECT category, NULL::STRING AS country, CAST(sum(n) AS BIGINT) AS n FROM ({_FACETS}) GROUP BY 1 HAVING sum(n) < 300 UNION ALL SELECT category, country, n FROM ({_FACETS}) WHERE category IN (SELECT category FROM ({_FACETS}) GROUP BY 1 HAVING sum(n) >= 300)")
def s35(s, d):
    return facets.slices(_facet_counts(s, d), 300)


@register("s35_sliced_union", "SELECT url, min(platform) AS platform FROM v_postings WHERE url <> '' GROUP BY url")
def s35_union(s, d):
    rows = view(s, d, "v_postings").filter("url <> ''").select(F.col("platform").alias("slice"), F.col("seq").alias("place"), "url", "platform")
    facets.check_totals(*[rows.groupBy(x).agg(F.count("*").alias("n")) for x in ("platform", "slice")])
    return facets.union(rows).select("url", "platform")


# ------------------------------------------------------------------ CSV and reports

_FLAGGED = "CASE WHEN remote IS NULL THEN '' WHEN remote THEN 'true' ELSE 'false' END AS remote"
_HAS = "NOT no_pay AND (pay_min <> 0 OR pay_max <> 0)"
_PLAIN = lambda x: f"CASE WHEN {_HAS} AND {x} > 0 THEN CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS STRING) ELSE CAST({x} AS STRING) END ELSE '' END"


@register("k03_csv_extended", f"SELECT company, title, {_FLAGGED}, coalesce({EMPLOYMENT}, '') AS employment_type, coalesce({WORKPLACE}, '') AS workplace_type, coalesce(strftime(posted_at, '%Y-%m-%dT%H:%M:%SZ'), '') AS posted_at, requisition_id, platform, source_key FROM v_postings")
def k03(s, d):
    rows = typed_postings(s, d).withColumns({"seniority": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("timestamp")})
    out = sinks.csv_frame(rows, extended=True)
    if len(out.columns) != 19:
        raise ValueError("the extended columns are 19")
    return out.select("company", "title", "remote", "employment_type", "workplace_type", "posted_at", "requisition_id", "platform", "source_key")


@register("k04_csv_columns", "SELECT * FROM (VALUES ('core', false, 8), ('one more', true, 2), ('unknown', NULL, 0)) t(asked, header, n)")
def k04(s, d):
    out = []
    for name, columns in (("core", None), ("one more", ["company", "platform"]), ("unknown", ["company", "no such"])):
        try:
            found, header = sinks.resolve_columns(columns)
            out.append((name, header, len(found)))
        except ValueError:
            out.append((name, None, 0))
    return s.createDataFrame(out, "asked string, header boolean, n int")


@register("k05_rendered_pay", f"SELECT seq, tie, {_PLAIN('pay_min')} AS compensation_min, {_PLAIN('pay_max')} AS compensation_max FROM v_postings")
def k05(s, d):
    rows = typed_postings(s, d).withColumns({"seniority": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("timestamp")})
    made = sinks.renderers()
    return rows.select("seq", "tie", made["compensation_min"].alias("compensation_min"), made["compensation_max"].alias("compensation_max"))


@register("k12_small_files", "SELECT 'second' AS held, true AS none_before")
def k12(s, d):
    path = folder(s, "manifest")
    before = corpus.read_text(s, path) is None
    corpus.write_text(s, path, "first")
    corpus.write_text(s, path, "second")
    return s.createDataFrame([(corpus.read_text(s, path), before)], "held string, none_before boolean")


@register("k15_refused_cells", "SELECT * FROM (VALUES ('plain', false), ('a\tb', true), ('a\nb', true)) t(cell, refused)")
def k15(s, d):
    def refused(cell: str) -> bool:
        try:
            sinks.tsv_frame(s.createDataFrame([(cell,)], "x string")).collect()
            return False
        except Exception as e:
            return "tab or line break" in str(e)

    return s.createDataFrame([(c, refused(c)) for c in ("plain", "a\tb", "a\nb")], "cell string, refused boolean")


@register("k16_candidates_tsv", "SELECT platform, key, company FROM v_sources")
def k16(s, d):
    path = folder(s, "candidates")
    sinks.write_tsv(view(s, d, "v_sources").select("platform", "key", "company").coalesce(1), path)
    return readers.tsv(s, path, ["platform", "key", "company"])


@register("k18_findings_file", f"SELECT a, b, CAST(shared AS BIGINT) AS req FROM ({_SHARED(_LINES)}) WHERE {_ENOUGH}")
def k18(s, d):
    path, found = folder(s, "findings"), resolve.findings(resolve.overlaps(_line_facts(s, d)))
    sinks.write_findings(found, path)
    return s.read.schema("a string, b string, req long").json(path)


_SHOWN = "CASE WHEN {0} = floor({0}) THEN format('{{:,}}', CAST({0} AS BIGINT)) ELSE format('{{:,.2f}}', {0}) END".format


@register("k20_result_items", f"SELECT seq, tie, CASE WHEN no_pay OR (pay_min = 0 AND pay_max = 0) THEN '' WHEN pay_min > 0 AND pay_max > 0 AND pay_min <> pay_max THEN {_SHOWN('pay_min')} || ' - ' || {_SHOWN('pay_max')} WHEN pay_min > pay_max THEN {_SHOWN('pay_min')} ELSE {_SHOWN('pay_max')} END AS pay FROM v_postings")
def k20(s, d):
    return sinks.result_items(typed_postings(s, d)).select("seq", "tie", F.coalesce("pay", F.lit("")).alias("pay"))


@register("k21_tool_payload", "SELECT * FROM (VALUES ('found', false, 50), ('refused', true, 0)) t(what, is_error, items)")
def k21(s, d):
    import json

    rows = Query(titles=("ring",)).apply(typed_postings(s, d)).select("company", "title", "location")
    found = sinks.tool_payload(search.page(rows, [F.col(x) for x in rows.columns], 50))
    refused = sinks.tool_refusal("a live search needs a company")
    out = [(n, p["isError"], len(p["structuredContent"].get("items", []))) for n, p in (("found", found), ("refused", refused))]
    json.dumps([found, refused])
    return s.createDataFrame(out, "what string, is_error boolean, items int")


# ------------------------------------------------------------------ sources, scans, filers


@register("s03_registry", "SELECT platform, key, company FROM v_sources")
def s03(s, d):
    return view(s, d, "v_sources").select("platform", "key", "company")


@register("s07_error_classes", "SELECT * FROM (VALUES ('TimeoutError', 'timeout'), ('CancelledError', 'canceled'), ('DeadlineExceeded', 'deadline'), ('ValueError', 'ValueError')) t(error, class)")
def s07(s, d):
    from ..sources.fixture import classify

    kinds = [TimeoutError, type("CancelledError", (Exception,), {}), type("DeadlineExceeded", (Exception,), {}), ValueError]
    return s.createDataFrame([(k.__name__, classify(k())) for k in kinds], "error string, class string")


@register("s10_page_guard", "SELECT * FROM (VALUES (0, false), (1, false), (2, true), (3, false)) t(page, repeated)")
def s10(s, d):
    from ..sources.fixture import PageGuard

    guard = PageGuard()
    return s.createDataFrame([(i, guard.repeated(ids)) for i, ids in enumerate((["a", "b"], ["c"], ["a", "b"], ["b", "a"]))], "page int, repeated boolean")


@register("p14_terms", "SELECT count(*) AS n FROM v_postings WHERE contains(lower(title), 'ring')")
def p14(s, d):
    from ..plans.query import any_term, terms

    found = terms(["", "  RING ", "\t"])
    return typed_postings(s, d).filter(any_term(F.col("title"), found)).agg(F.count("*").alias("n"))


@register("p22_unknown_employers", "SELECT count(*) AS n FROM v_postings p JOIN v_employers e ON lower(p.platform) = lower(e.platform) AND lower(p.source_key) = lower(e.key) WHERE NOT e.public OR e.employees >= 1000000")
def p22(s, d):
    from ..plans.query import EmployerFilter

    rows = employers.attach(typed_postings(s, d), _employers(s, d))
    return EmployerFilter(private=True).apply(rows).agg(F.count("*").alias("n"))


@register("p29_flattened_columns", "SELECT 'employer' AS lost, count(*) AS rows FROM v_postings")
def p29_columns(s, d):
    rows = employers.attach(typed_postings(s, d), _employers(s, d))
    flat = employers.flatten(rows)
    lost = ",".join(sorted(set(rows.columns) - set(flat.columns)))
    return flat.agg(F.count("*").alias("rows")).select(F.lit(lost).alias("lost"), "rows")


@register("e02_without_shells", "SELECT s_suppkey AS entity, CAST(s_nationkey AS STRING) AS sic FROM supplier WHERE s_nationkey <> 7")
def e02(s, d):
    rows = _table(s, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").cast("string").alias("sic"))
    return resolve.drop_shells(rows.select("entity"), rows, "7").select("entity", "sic")


@register("j10_failed_look_ups", "SELECT * FROM (VALUES ('a tenth', false), ('half', true)) t(lost, refused)")
def j10(s, d):
    rows = _table(s, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.lit("1").alias("sic"))
    most, half = rows.filter("entity % 10 <> 0"), rows.filter("entity % 2 = 0")
    return s.createDataFrame([("a tenth", tells(resolve.drop_shells, rows.select("entity"), most)), ("half", tells(resolve.drop_shells, rows.select("entity"), half))], "lost string, refused boolean")


@register("j11_shared_evidence", f"SELECT 'p/' || a.src AS a, 'p/' || b.src AS b, count(*) AS shared FROM ({_EVID}) a JOIN ({_EVID}) b ON a.v = b.v AND 'p/' || CAST(a.src AS STRING) < 'p/' || CAST(b.src AS STRING) GROUP BY 1, 2 HAVING count(*) >= 3")
def j11(s, d):
    return resolve.overlaps(_facts(s, d)).filter("shared >= 3").select("a", "b", "shared")


@register("j14_measured_groups", "SELECT grp AS \"group\", count(*) AS runs FROM (SELECT day, CAST(CAST(key AS BIGINT) % 10 AS STRING) AS grp, max(last_s) - min(first_s) AS span FROM v_runs WHERE duration_ms > 0 GROUP BY 1, 2) WHERE span > 0 GROUP BY 1")
def j14(s, d):
    rows = _runs(s, d)
    at = lambda x: F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + F.col(x))
    runs = rows.withColumns({"run": F.col("day"), "started_at": at("first_s"), "finished_at": at("last_s")})
    groups = rows.select("platform", "key", (F.col("key").cast("long") % 10).cast("string").alias("group")).distinct()
    return schedule.group_parallelism(runs, groups).select("group", F.col("samples").alias("runs"))


@register("w08_failures_in_a_row", "SELECT key, CAST(count(*) FILTER (WHERE status = 'failed' AND day > coalesce(done, DATE '1970-01-01')) AS INT) AS failures FROM (SELECT *, max(CASE WHEN status = 'complete' THEN day END) OVER (PARTITION BY key) AS done FROM v_runs WHERE day IN (SELECT DISTINCT day FROM v_runs ORDER BY day DESC LIMIT 4)) GROUP BY 1")
def w08(s, d):
    from functools import reduce

    rows, empty = _runs(s, d).withColumn("error_class", F.lit("")), s.createDataFrame([], SCHED_SOURCES)
    days = [r["day"] for r in rows.select("day").distinct().orderBy("day").collect()][-4:]  # a fold for each of the last days
    last = rows.filter(F.col("day").isin(days))
    state = reduce(lambda st, day: schedule.fold_state(st, last.filter(F.col("day") == F.lit(day)), instant("2024-01-31T00:00:00")), days, empty)
    return state.select("key", F.col("consecutive_failures").alias("failures"))


@register("s20_ranges_of_files", "SELECT * FROM (VALUES ('head', 'PAR1'), ('tail', 'PAR1'), ('beyond', ''), ('outside', 'refused')) t(part, held)")
def s20(s, d):
    from ..sources.store import RangeStore

    store, path = RangeStore(s, shared_dir(s)), folder(s, "ranges")
    _table(s, d, "nation").coalesce(1).write.parquet(path)
    readers.place_part(s, path, path + ".parquet")
    name = at_end(s, path + ".parquet").rsplit("/", 1)[1]
    size = store.size(name)
    held = {"head": store.read(name, 0, 4), "tail": store.read(name, size - 4, 99), "beyond": store.read(name, size + 5, 9)}
    outside = "refused" if tells(store.read, f"../{name}", 0, 4) else "read"
    return s.createDataFrame([*((k, v.decode()) for k, v in held.items()), ("outside", outside)], "part string, held string")
