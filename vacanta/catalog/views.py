"""Job-posting views over the driver's tables: one text for Spark and for DuckDB.

Every view is a plain SELECT that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab

#: Fixed clock of the lifecycle queries.
NOW = "2001-01-01 00:00:00"

POSTINGS = """
SELECT l_orderkey * 10 + l_linenumber AS seq,
  CAST(l_partkey AS STRING) || '/' || CAST(l_suppkey AS STRING) || '/' || CAST(l_quantity AS STRING) || '/' || CAST(l_extendedprice AS STRING)
    || '/' || l_returnflag || l_linestatus || '/' || CAST(l_discount AS STRING) || '/' || CAST(l_tax AS STRING) AS tie,
  s_name AS company, lower(r_name) AS platform, CAST(s_suppkey AS STRING) AS source_key, p_name AS title, p_brand AS department, p_type AS team,
  n_name || CASE l_linenumber % 7 WHEN 1 THEN ', Remote' WHEN 2 THEN ' (Hybrid)' WHEN 3 THEN ' - Work From Home' WHEN 4 THEN '' ELSE ', Office' END AS location,
  CASE WHEN l_linenumber = 7 THEN '' ELSE 'https://jobs.example.com/' || CAST(s_suppkey AS STRING) || '/' || CAST(p_partkey AS STRING) END AS url,
  CAST(l_orderkey AS STRING) AS requisition_id,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) END AS external_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Full-Time' WHEN '2-HIGH' THEN 'FULL_TIME' WHEN '3-MEDIUM' THEN 'Contractor (W2)' WHEN '5-LOW' THEN 'Intern, Summer' ELSE 'Regular' END AS employment_raw,
  CASE l_linenumber % 6 WHEN 0 THEN 'Hybrid Remote' WHEN 1 THEN 'In-Office' WHEN 2 THEN 'WFH' ELSE NULL END AS workplace_raw,
  l_linenumber = 6 AS no_pay,
  CASE WHEN l_linenumber % 4 = 0 THEN 0.0 ELSE p_retailprice END AS pay_min,
  CASE WHEN l_linenumber % 5 = 0 THEN 0.0 ELSE l_extendedprice END AS pay_max,
  CASE l_returnflag WHEN 'A' THEN 'year' WHEN 'N' THEN 'month' ELSE NULL END AS pay_period,
  CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS remote,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_shipdate AS TIMESTAMP) END AS posted_at
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
JOIN region ON r_regionkey = n_regionkey LEFT JOIN orders ON o_orderkey = l_orderkey
"""

SOURCES = """
SELECT s_suppkey AS reg_idx, lower(r_name) AS platform, CAST(s_suppkey AS STRING) AS key,
  CASE WHEN s_suppkey % 3 = 0 THEN upper('Company ' || CAST(s_suppkey % 40 AS STRING)) ELSE 'Company ' || CAST(s_suppkey % 40 AS STRING) END AS company
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
"""

EMPLOYERS = """
SELECT upper(platform) AS platform, key, company || ', Inc.' AS legal_name,
  CASE reg_idx % 4 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS public,
  CAST(reg_idx % 7 * 100 AS INT) AS employees,
  CASE reg_idx % 5 WHEN 0 THEN 'Software' WHEN 1 THEN 'Retail Trade' ELSE 'Services' END AS industry,
  CAST(1000 + reg_idx % 9 AS STRING) AS sic
FROM v_sources WHERE reg_idx % 3 <> 2
"""

RUNS = """
SELECT day, 'events' AS platform, CAST(user_id AS STRING) AS key, 'User ' || CAST(user_id AS STRING) AS company,
  CASE WHEN errs >= 3 THEN 'failed' WHEN user_id % 29 = 0 THEN 'truncated' ELSE 'complete' END AS status,
  CAST(CASE WHEN errs = 2 THEN 1 ELSE 0 END AS INT) AS errors, CAST(n - errs AS INT) AS postings,
  CAST(n * 1000 + user_id AS BIGINT) AS duration_ms, first_s, last_s
FROM (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errs,
  min(CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 AS BIGINT)) AS first_s,
  max(CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 AS BIGINT)) AS last_s
  FROM events GROUP BY CAST(ts AS DATE), user_id) e
"""


def span(ends: list[str]) -> str:
    """SQL of the last day of the span that an event lies in; the last span has no end."""
    return "CASE " + " ".join(f"WHEN CAST(ts AS DATE) <= DATE '{e}' THEN DATE '{e}'" for e in ends[:-1]) + f" ELSE DATE '{ends[-1]}' END"


#: The events as two, four or thirty runs: each takes all events of its span.
TWO = ["2024-01-03", "2024-01-30"]
WEEKS = ["2024-01-08", "2024-01-16", "2024-01-23", "2024-01-30"]
DAYS = [f"2024-01-{n:02d}" for n in range(1, 31)]


def runs_of(ends: list[str]) -> str:
    return RUNS.replace("CAST(ts AS DATE)", span(ends))


VIEWS = {"v_sources": SOURCES, "v_postings": POSTINGS, "v_employers": EMPLOYERS, "v_runs": RUNS}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables of ``sf_dir``."""
    text = VIEWS[name]
    for t in TABLES:
        if t in text or name == "v_employers":
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    if name == "v_employers":
        spark.sql(SOURCES).createOrReplaceTempView("v_sources")
    return spark.sql(text)


def oracle(sql: str) -> str:
    """``sql`` after the views that it names; as it is where it starts with its own."""
    if sql.startswith("WITH "):
        return sql
    names = [n for n in VIEWS if n in sql or (n == "v_sources" and "v_employers" in sql)]
    return f"WITH {', '.join(f'{n} AS ({VIEWS[n]})' for n in names)} {sql}" if names else sql


def typed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings in the engine's own schema, with ``seq`` and ``tie`` as their total order."""
    c = F.col
    raw = view(spark, sf_dir, "v_postings")
    pay = F.struct(c("pay_min").alias("min"), c("pay_max").alias("max"), F.lit("USD").alias("currency"), c("pay_period").alias("period"), F.lit("").alias("summary"), F.lit("employer").alias("provenance"))
    return raw.select(
        "seq", "tie", "company", "platform", "source_key", "title", "department", "team", "location", "url", "requisition_id", "external_id",
        vocab.employment_type(c("employment_raw")).alias("employment_type"),
        vocab.workplace_type(c("workplace_raw")).alias("workplace_type"),
        F.when(~c("no_pay"), pay).alias("compensation"), "remote", "posted_at", c("source_key").alias("key"),
        F.struct("platform", c("source_key").alias("key")).alias("source"),
    )
