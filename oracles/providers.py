"""Oracles of the provider queries."""

from __future__ import annotations

from oracles.base import query
from oracles.features import BASE, TIME_OF_DAY


def oracles() -> dict[str, str]:
    return {
        "udx01_custom_extractor": query("orders", [BASE], """SELECT geo_location, count(*) AS active_months,
          round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS peak_month_share
          FROM (SELECT geo_location, date_trunc('month', ts) AS m, count(*) AS n FROM v GROUP BY 1, 2)
          WHERE geo_location IN (SELECT geo_location FROM base) GROUP BY 1"""),
        "udx04_provider_taxonomy": query("orders", [BASE, TIME_OF_DAY], """SELECT geo_location, CASE
          WHEN downloads_per_user >= 1.06 AND unique_users <= 480 THEN 'automated'
          WHEN coalesce(working_hours_ratio, 0) >= 0.335 THEN 'organic'
          WHEN unique_users <= 500 THEN 'organic' WHEN unique_users > 500 THEN 'automated' ELSE 'unknown' END
          AS behavior_type FROM base LEFT JOIN time_of_day USING (geo_location)"""),
    }
