"""Folds of whole runs and what is stored of them, each with SQL that repeats the fold run by run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import hashes
from ..operators import corpus, sinks
from ..operators.storage import shared_dir
from .queries import _folds, _runs, instant, register
from .views import DAYS, TWO, WEEKS, runs_of, span, typed_postings, view

def fold_sql(ends: list[str], ask: str) -> str:
    """``ask`` over rows_n (key, title, missing, reopens, closed, first_at, seen_at, outcome)
    and src_n (key, tried, q, trail, streak, failures) after the runs
    of all events, dealt into spans that end at ``ends``."""
    parts = [
        "rows_0 AS (SELECT CAST(NULL AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS title, 0 AS missing, 0 AS reopens, CAST(NULL AS VARCHAR) AS closed, "
        "CAST(NULL AS TIMESTAMP) AS first_at, CAST(NULL AS TIMESTAMP) AS seen_at, '' AS outcome WHERE false)",
        "src_0 AS (SELECT CAST(NULL AS VARCHAR) AS key, CAST(NULL AS TIMESTAMP) AS tried, CAST(NULL AS TIMESTAMP) AS q, CAST([] AS BIGINT[]) AS trail, 0 AS streak, 0 AS failures WHERE false)",
    ]
    for i, day in enumerate(ends, 1):
        at, j = f"TIMESTAMP '{day} 12:00:00'", i - 1
        median = "CASE WHEN coalesce(len(trail), 0) = 0 THEN 0 WHEN len(trail) % 2 = 1 THEN list_sort(trail)[len(trail) // 2 + 1] ELSE (list_sort(trail)[len(trail) // 2] + list_sort(trail)[len(trail) // 2 + 1]) // 2 END"
        parts += [
            f"run_{i} AS MATERIALIZED (SELECT r.*, s.q AS was_q, s.trail, s.streak, r.status = 'complete' AND r.errors = 0 AND CASE WHEN {median} <= 0 THEN true "
            f"WHEN r.postings = 0 AND coalesce(s.streak, 0) + 1 < 3 THEN false WHEN r.postings > 0 AND r.postings < 0.25 * {median} THEN false ELSE true END AS ok "
            f"FROM v_runs r LEFT JOIN src_{j} s ON r.key = s.key WHERE r.day = DATE '{day}')",
            f"rows_{i} AS MATERIALIZED (SELECT key, title, CASE WHEN new THEN 0 WHEN gone THEN missing + 1 ELSE missing END AS missing, "
            f"reopens + CASE WHEN new AND old AND closed IS NOT NULL THEN 1 ELSE 0 END AS reopens, "
            f"CASE WHEN new THEN NULL WHEN gone AND missing + 1 >= 2 THEN 'absent' ELSE closed END AS closed, coalesce(first_at, {at}) AS first_at, "
            f"CASE WHEN new THEN (CASE WHEN NOT ok THEN {at} END) WHEN gone THEN coalesce(seen_at, was_q) ELSE seen_at END AS seen_at, "
            "CASE WHEN NOT old THEN 'new' WHEN new AND closed IS NOT NULL THEN 'reopened' WHEN new THEN 'unchanged' WHEN gone AND missing + 1 >= 2 THEN 'closed' WHEN gone THEN 'missing' ELSE 'untouched' END AS outcome "
            "FROM (SELECT coalesce(b.key, n.key) AS key, coalesce(b.title, n.title) AS title, coalesce(b.missing, 0) AS missing, coalesce(b.reopens, 0) AS reopens, b.closed, b.first_at, b.seen_at, "
            "b.key IS NOT NULL AS old, n.key IS NOT NULL AS new, v.was_q, coalesce(v.ok, false) AS ok, b.key IS NOT NULL AND n.key IS NULL AND b.closed IS NULL AND coalesce(v.ok, false) AS gone "
            f"FROM rows_{j} b FULL JOIN (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, event_type AS title FROM events WHERE {span(ends)} = DATE '{day}') n ON b.key = n.key AND b.title = n.title "
            f"LEFT JOIN run_{i} v ON v.key = coalesce(b.key, n.key)))",
            f"src_{i} AS MATERIALIZED (SELECT coalesce(s.key, r.key) AS key, CASE WHEN r.key IS NOT NULL THEN {at} ELSE s.tried END AS tried, CASE WHEN r.ok THEN {at} ELSE s.q END AS q, "
            "CASE WHEN r.ok THEN list_slice(list_append(coalesce(s.trail, []), CAST(r.postings AS BIGINT)), greatest(len(coalesce(s.trail, [])) + 1 - 6, 1), 99) ELSE coalesce(s.trail, []) END AS trail, "
            "CASE WHEN r.status = 'complete' AND r.errors = 0 THEN (CASE WHEN r.postings = 0 THEN coalesce(s.streak, 0) + 1 ELSE 0 END) ELSE coalesce(s.streak, 0) END AS streak, "
            "CASE WHEN r.key IS NULL THEN s.failures WHEN r.status = 'complete' AND r.errors = 0 THEN 0 ELSE coalesce(s.failures, 0) + 1 END AS failures "
            f"FROM src_{j} s FULL JOIN run_{i} r ON s.key = r.key)",
        ]
    n = len(ends)
    now = f"TIMESTAMP '{ends[-1]} 12:00:00'"
    state = f"CASE WHEN rows_n.closed IS NOT NULL THEN 'closed' WHEN src_n.q IS NULL THEN 'lapsed' WHEN {now} - src_n.q >= INTERVAL 1 DAY THEN 'stale' ELSE 'open' END"
    named = ask.replace("$state", state).replace("rows_n", f"rows_{n}").replace("src_n", f"src_{n}").replace("run_n", f"run_{n}")
    return f"WITH v_runs AS ({runs_of(ends)}), {', '.join(parts)} {named}"


ID = "substr(sha256('jht-corpus-id-v1' || chr(0) || 'events' || chr(0) || rows_n.key || chr(0) || 'descriptor' || chr(0) || sha256(title || chr(0) || '') || chr(0)), 1, 32)"
JOINED = "FROM rows_n LEFT JOIN src_n ON rows_n.key = src_n.key"
WHOLE = f"SELECT {ID} AS id, 'descriptor' AS basis, CAST(missing AS INT) AS missing, CAST(reopens AS INT) AS reopens, outcome, $state AS state, closed AS closed_reason {JOINED}"
ROWS = ["id", "basis", "missing", "reopens", "outcome", "state"]


def _whole(done):
    return done.rows.select(*ROWS, F.col("closed.reason").alias("closed_reason"))


@register("l05_fold_two_runs", fold_sql(TWO, "SELECT outcome, count(*) AS n FROM rows_n GROUP BY 1"))
def l05(s, d):
    return _folds(s, d, TWO).churn


@register("l09_fold_four_runs", fold_sql(WEEKS, WHOLE))
def l09(s, d):
    return _whole(_folds(s, d, WEEKS))


@register("l09_fold_all_days", fold_sql(DAYS, WHOLE))
def l09_all(s, d):
    return _whole(_folds(s, d, DAYS))


@register("l07_refreshed_rows", fold_sql(WEEKS, f"SELECT {ID} AS id, CAST(epoch_ms(first_at) AS BIGINT) AS first_seen, CAST(coalesce(epoch_ms(seen_at), -1) AS BIGINT) AS last_seen {JOINED} WHERE outcome IN ('new', 'unchanged', 'reopened')"))
def l07(s, d):
    rows = _folds(s, d, WEEKS).rows.filter(F.col("outcome").isin("new", "unchanged", "reopened"))
    return rows.select("id", F.unix_millis("first_seen").alias("first_seen"), F.coalesce(F.unix_millis("last_seen"), F.lit(-1)).alias("last_seen"))


@register("l08_absent_rows", fold_sql(WEEKS, f"SELECT {ID} AS id, outcome, CAST(missing AS INT) AS missing, CAST(coalesce(epoch_ms(seen_at), -1) AS BIGINT) AS last_seen, closed AS closed_reason {JOINED} WHERE outcome IN ('closed', 'missing', 'untouched')"))
def l08(s, d):
    rows = _folds(s, d, WEEKS).rows.filter(F.col("outcome").isin("closed", "missing", "untouched"))
    return rows.select("id", "outcome", "missing", F.coalesce(F.unix_millis("last_seen"), F.lit(-1)).alias("last_seen"), F.col("closed.reason").alias("closed_reason"))


@register("l10_source_states", fold_sql(WEEKS, "SELECT key, CAST(epoch_ms(tried) AS BIGINT) AS last_attempt, CAST(coalesce(epoch_ms(q), -1) AS BIGINT) AS last_qualifying, array_to_string(trail, ',') AS trailing, CAST(streak AS INT) AS empty_streak, CAST(failures AS INT) AS consecutive_failures FROM src_n"))
def l10(s, d):
    rows = _folds(s, d, WEEKS).sources
    trail = F.array_join(F.transform("trailing", lambda x: x.cast("string")), ",").alias("trailing")
    return rows.select("source.key", F.unix_millis("last_attempt").alias("last_attempt"), F.coalesce(F.unix_millis("last_qualifying"), F.lit(-1)).alias("last_qualifying"), trail, "empty_streak", "consecutive_failures")


@register("l12_open_counts", fold_sql(WEEKS, f"SELECT key, CAST(count(*) FILTER (WHERE state = 'open') AS INT) AS open FROM (SELECT src_n.key, $state AS state, rows_n.title FROM src_n LEFT JOIN rows_n ON rows_n.key = src_n.key) WHERE true GROUP BY 1"))
def l12(s, d):
    return _folds(s, d, WEEKS).sources.select("source.key", "open")


@register("g14_churn", fold_sql(WEEKS, "SELECT outcome, count(*) AS n FROM rows_n GROUP BY 1"))
def g14(s, d):
    return _folds(s, d, WEEKS).churn


@register("j05_verdicts_of_a_run", fold_sql(WEEKS, "SELECT key, ok FROM run_n"))
def j05(s, d):
    return _folds(s, d, WEEKS).verdicts.select("key", F.col("qualifies").alias("ok"))


def _stored(s, d):
    """A generation of the four runs, published and opened again."""
    folder = f"{shared_dir(s)}/corpus-{uuid.uuid4().hex}"
    corpus.publish(folder, 1, _folds(s, d, WEEKS), instant("2024-01-30T12:00:00"))
    corpus.verify(s, folder)
    return folder, *corpus.open_corpus(s, folder)


@register("k09_published_rows", fold_sql(WEEKS, WHOLE))
def k09(s, d):
    rows = _stored(s, d)[2]
    return rows.select(*ROWS, F.col("closed.reason").alias("closed_reason"))


@register("l13_verified_counts", fold_sql(WEEKS, f"SELECT count(*) FILTER (WHERE state = 'open') AS open, count(*) FILTER (WHERE state = 'stale') AS stale, count(*) FILTER (WHERE state = 'closed') AS closed, count(*) FILTER (WHERE state = 'lapsed') AS lapsed, count(*) AS rows FROM (SELECT $state AS state {JOINED})"))
def l13(s, d):
    counts = _stored(s, d)[1]["counts"]
    return s.createDataFrame([tuple(counts[x] for x in ("open", "stale", "closed", "lapsed", "rows"))], "open long, stale long, closed long, lapsed long, rows long")


@register("l17_inspected_runs", fold_sql(WEEKS, "SELECT outcome, count(*) AS n FROM rows_n GROUP BY 1"))
def l17(s, d):
    run = corpus.inspect(s, _stored(s, d)[0], 1)["runs"][-1]
    return s.createDataFrame(sorted(run["churn"].items()), "outcome string, n long")


@register("k08_flat_columns", fold_sql(WEEKS, f"SELECT {ID} AS id, rows_n.key AS source_key, title, CAST(epoch_ms(first_at) AS BIGINT) AS first_seen, coalesce(closed, '') AS closed_reason, 0 AS remote, 0 AS compensation {JOINED}"))
def k08(s, d):
    return corpus.flat(_folds(s, d, WEEKS).rows).select("id", "source_key", "title", "first_seen", "closed_reason", "remote", "compensation")


@register("j06_seen_and_state", fold_sql(WEEKS, f"SELECT {ID} AS id, CAST(coalesce(epoch_ms(coalesce(seen_at, src_n.q)), -1) AS BIGINT) AS seen, CASE WHEN closed IS NOT NULL THEN 'closed' WHEN src_n.q IS NULL THEN 'lapsed' WHEN TIMESTAMP '2024-02-01 00:00:00' - src_n.q >= INTERVAL 1 DAY THEN 'stale' ELSE 'open' END AS state {JOINED}"))
def j06(s, d):
    done = _folds(s, d, WEEKS)
    rows = corpus.with_state(done.rows.drop("state"), done.sources, instant("2024-02-01T00:00:00"))
    return rows.select("id", F.coalesce(F.unix_millis("seen"), F.lit(-1)).alias("seen"), "state")


@register("l15_empty_corpus", "SELECT 0::BIGINT AS rows, 0::BIGINT AS sources")
def l15(s, d):
    rows, sources = corpus.empty(s)
    return rows.agg(F.count("*").alias("rows")).crossJoin(sources.agg(F.count("*").alias("sources")))  # a row each


@register("l16_no_manifest_is_empty", "SELECT 0::BIGINT AS rows, true AS first")
def l16(s, d):
    manifest, rows, _ = corpus.open_corpus(s, f"{shared_dir(s)}/no-corpus-{uuid.uuid4().hex}")
    return rows.agg(F.count("*").alias("rows")).withColumn("first", F.lit(manifest is None))


@register("l18_refused_runs", "SELECT * FROM (VALUES ('as it is', false), ('twice', true), ('no clock', true)) t(run, refused)")
def l18(s, d):
    runs = view(s, d, "v_runs").filter("day = DATE '2024-01-03'").select("platform", "key")
    out = []
    for name, frame, clock in (("as it is", runs, 1), ("twice", runs.unionByName(runs), 1), ("no clock", runs, None)):
        try:
            corpus.check_run(frame, clock and instant("2024-01-03T12:00:00"))
            out.append((name, False))
        except ValueError:
            out.append((name, True))
    return s.createDataFrame(out, "run string, refused boolean")


@register("l11_changed", "SELECT seq, tie, no_pay OR pay_min <> pay_max OR remote IS NULL AS changed FROM v_postings")
def l11(s, d):
    rows = typed_postings(s, d)
    pay = F.when(F.col("compensation").isNotNull(), F.struct(F.col("compensation.max").alias("min"), F.col("compensation.max").alias("max")))
    old = F.struct(F.coalesce("remote", F.lit(True)).alias("remote"), "title", "posted_at", F.coalesce(pay, F.struct(F.lit(-1.0).alias("min"), F.lit(-1.0).alias("max"))).alias("pay"))
    new = F.struct("remote", "title", "posted_at", F.when(F.col("compensation").isNotNull(), F.struct(F.col("compensation.min").alias("min"), F.col("compensation.max").alias("max"))).alias("pay"))
    return rows.select("seq", "tie", corpus.changed(old, new).alias("changed"))


_BASES = "SELECT p.*, CASE WHEN e_ok AND external_id IS NOT NULL THEN external_id WHEN r_ok THEN requisition_id WHEN u_ok AND url <> '' THEN url ELSE sha256(title || chr(0) || location) END AS v FROM v_postings p JOIN (SELECT platform, source_key, count(external_id) = count(DISTINCT external_id) AS e_ok, count(requisition_id) = count(DISTINCT requisition_id) AS r_ok, count(nullif(url, '')) = count(DISTINCT nullif(url, '')) AS u_ok FROM v_postings GROUP BY 1, 2) USING (platform, source_key)"


@register("w03_first_of_an_id", f"SELECT seq, source_key, title FROM ({_BASES}) QUALIFY row_number() OVER (PARTITION BY platform, source_key, v ORDER BY seq, tie) = 1")
def w03(s, d):
    rows = typed_postings(s, d)
    return corpus.first_wins(corpus.identify(rows), ["platform", "key", "id"], ["seq", "tie"]).select("seq", "source_key", "title")


# ------------------------------------------------------------------ plans of shards and schedules


@register("f26_source_set_id", "SELECT substr(sha256(string_agg(platform || chr(9) || key || chr(10), '' ORDER BY platform || chr(9) || key)), 1, 32) AS id, count(*) AS n FROM v_sources")
def f26(s, d):
    rows = [(r["platform"], r["key"]) for r in view(s, d, "v_sources").select("platform", "key").collect()]  # a registry has some thousands of rows
    return s.createDataFrame([(hashes.source_set_id(rows), len(rows))], "id string, n long")


@register("k10_churn_report", "SELECT what, count(*) AS n FROM (SELECT unnest([status, 'refused: ' || status]) AS what FROM v_runs) GROUP BY 1")
def k10(s, d):
    churn = _runs(s, d).groupBy(F.col("status").alias("outcome")).agg(F.count("*").alias("n"))
    return sinks.churn_report(churn, churn.select(F.col("outcome").alias("verdict"), "n"))
