"""Oracles of the streaming roll-ups: the same tables from all events at once."""

from __future__ import annotations

from oracles.base import query

SESSION_ROWS = """s1 AS (SELECT geo_location, epoch_us(ts) AS us,
  lag(epoch_us(ts)) OVER (PARTITION BY geo_location ORDER BY ts) AS prev FROM v),
s2 AS (SELECT geo_location, us, sum(CASE WHEN prev IS NULL OR us - prev > 1800000000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY geo_location ORDER BY us) AS session FROM s1)"""


def oracles() -> dict[str, str]:
    return {
        "str01_hourly_stream": query("events", [], "SELECT geo_location, epoch_us(h) AS hour_us, n FROM hr"),
        "str02_session_stream": query("events", [SESSION_ROWS], "SELECT geo_location, min(us) AS first_us, "
                                      "max(us) AS last_us, count(*) AS n FROM s2 GROUP BY geo_location, session"),
    }
