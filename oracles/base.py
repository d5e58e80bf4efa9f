"""Shared pieces of the DuckDB oracles: the two log fixtures and output formatting.

The oracles are straight SQL over all events (row-level windows, self joins, full grids); they
share no logic with the Spark jobs.
"""

from __future__ import annotations

ORDERS = """SELECT
  concat(CAST(s_nationkey*5-60 AS VARCHAR), '.', lpad(CAST((s_suppkey%10)*4 AS VARCHAR),2,'0'), ',', CAST(s_nationkey*10-120 AS VARCHAR), '.50') AS geo_location,
  n_name AS country, r_name AS region,
  concat('City_', CAST(s_nationkey AS VARCHAR), '_', CAST(s_suppkey%10 AS VARCHAR)) AS city,
  concat('u', CAST(o_custkey AS VARCHAR)) AS usr,
  concat('PXD', lpad(CAST(l_partkey AS VARCHAR),6,'0')) AS accession,
  concat('f', CAST(l_partkey%500 AS VARCHAR), '_v1.', CAST(l_linenumber%3 AS VARCHAR), '.0',
    CASE l_partkey%8 WHEN 0 THEN '.raw' WHEN 1 THEN '.mzML' WHEN 2 THEN '.mzid.gz' WHEN 3 THEN '.csv'
      WHEN 4 THEN '.fasta' WHEN 5 THEN '.sdrf.tsv' WHEN 6 THEN '.zip' ELSE '.dat' END) AS filename,
  CASE WHEN l_orderkey%10=0 THEN 'fasp-aspera' WHEN l_orderkey%10=1 THEN 'gridftp-globus'
       WHEN l_orderkey%10<5 THEN 'ftp' ELSE 'http' END AS method,
  l_shipdate + to_seconds((l_orderkey*7919+l_linenumber*104729)%86400) AS ts
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN supplier ON l_suppkey=s_suppkey
JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey"""

EVENTS = """SELECT
  concat(CAST((user_id%25)*5-60 AS VARCHAR), '.00,', CAST((user_id%25)*10-120 AS VARCHAR), '.50') AS geo_location,
  n_name AS country, r_name AS region, concat('City_', CAST(user_id%25 AS VARCHAR), '_0') AS city,
  concat('u', CAST(user_id AS VARCHAR)) AS usr,
  concat('PXD', lpad(json_extract_string(props,'$.k'),6,'0')) AS accession,
  concat('f', json_extract_string(props,'$.k'), '_v1.', CAST(event_id%3 AS VARCHAR), '.0.raw') AS filename,
  CASE event_type WHEN 'purchase' THEN 'ftp' WHEN 'signup' THEN 'fasp-aspera' WHEN 'error' THEN 'gridftp-globus' ELSE 'http' END AS method,
  ts
FROM events JOIN nation ON user_id%25=n_nationkey JOIN region ON n_regionkey=r_regionkey"""

MIN_YEAR = 1995


def log_ctes(source: str, min_year: int = MIN_YEAR) -> list[str]:
    body = {"orders": ORDERS, "events": EVENTS}[source]
    return [
        f"raw AS ({body})",
        "log AS (SELECT *, CAST(year(ts) AS BIGINT) AS year FROM raw)",
        "v AS (SELECT * FROM log WHERE geo_location IS NOT NULL AND ts IS NOT NULL)",
        f"vy AS (SELECT * FROM v WHERE year >= {min_year})",
        "hr AS (SELECT geo_location, date_trunc('hour', ts) AS h, count(*) AS n, "
        "count(DISTINCT usr) AS u FROM v GROUP BY 1, 2)",
        "dy AS (SELECT geo_location, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, "
        "count(*) AS n FROM v GROUP BY 1, 2)",
        "wk AS (SELECT geo_location, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, "
        "count(*) AS n FROM v GROUP BY 1, 2)",
    ]


def query(source: str | None, ctes: list[str], final: str) -> str:
    parts = (log_ctes(source) if source else []) + ctes
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final


def out(columns: str, frm: str) -> str:
    """SELECT list from a compact spec: ``name`` kept, ``name:i`` bigint, ``name:r`` rounded to
    six digits, ``name:3`` rounded to three."""
    items = []
    for spec in columns.split():
        name, _, kind = spec.partition(":")
        if not kind:
            items.append(name)
        elif kind == "i":
            items.append(f"CAST({name} AS BIGINT) AS {name}")
        else:
            k = 6 if kind == "r" else int(kind)
            items.append(f"round(CAST({name} AS DOUBLE), {k}) + 0.0 AS {name}")
    return "SELECT " + ", ".join(items) + " FROM " + frm
