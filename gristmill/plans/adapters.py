"""Views that stand the test tables in for postings. Their SQL is one text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = "2001-08-02 00:00:00"


def _id(k: str) -> str:
    return f"concat(CASE ({k}) % 3 WHEN 0 THEN 'lever' WHEN 1 THEN 'ashby' ELSE 'themuse' END, ':b', CAST(({k}) % 50 AS STRING), ':', CAST({k} AS STRING))"


#: Orders as postings: the customer as company, its region as place; every seventh order copies the one before.
JOBS = f"""
SELECT {_id('o_orderkey')} AS id,
  CASE o_orderkey % 3 WHEN 0 THEN 'lever' WHEN 1 THEN 'ashby' ELSE 'themuse' END AS source,
  concat(CASE o_orderkey % 3 WHEN 0 THEN 'lever' WHEN 1 THEN 'ashby' ELSE 'themuse' END, ':b', CAST(o_orderkey % 50 AS STRING)) AS board_key,
  CAST(o_orderkey % 3 AS INT) AS rank, c_name AS company, n_name AS place,
  CASE r_name WHEN 'AMERICA' THEN 'usa' WHEN 'EUROPE' THEN 'other' WHEN 'ASIA' THEN 'remote' ELSE 'unknown' END AS location,
  CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status, o_orderpriority AS role,
  CASE o_orderkey % 4 WHEN 0 THEN 'FR' WHEN 1 THEN 'bilingual' ELSE 'EN' END AS language,
  o_orderdate AS first_seen, o_orderdate + INTERVAL '20' DAY AS last_seen,
  CASE WHEN o_orderkey % 7 = 3 THEN {_id('(o_orderkey - 1)')} END AS duplicate_of, o_totalprice AS price
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

#: Events as visits of boards: an error is a failed visit.
VISITS = """
SELECT CAST(user_id AS STRING) AS board, event_type AS source, ts, value, event_id,
  CASE WHEN event_id % 5 < 2 THEN 1 ELSE 0 END AS failed FROM events
"""

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the test tables, which are named plainly in it."""
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, JOBS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
