"""DuckDB SQL for the location features."""

from __future__ import annotations

from oracles.base import out, query

# ---------------------------------------------------------------- feature CTEs

BASE = """base AS (
  SELECT a.geo_location, c.country, a.city, a.unique_users, a.total_downloads, a.unique_projects,
    a.active_hours, a.years_active, a.first_year, a.last_year,
    CAST(a.total_downloads AS DOUBLE) / NULLIF(a.unique_users, 0) AS downloads_per_user
  FROM (SELECT geo_location, max(city) AS city, count(DISTINCT usr) AS unique_users,
          count(*) AS total_downloads, count(DISTINCT accession) AS unique_projects,
          count(DISTINCT date_trunc('hour', ts)) AS active_hours,
          count(DISTINCT year) AS years_active, min(year) AS first_year, max(year) AS last_year
        FROM vy GROUP BY geo_location) a
  LEFT JOIN (SELECT geo_location, country FROM (
      SELECT geo_location, country, row_number() OVER (PARTITION BY geo_location
        ORDER BY count(*) DESC, country) AS r
      FROM vy WHERE country IS NOT NULL GROUP BY 1, 2) WHERE r = 1) c USING (geo_location))"""

HOURLY = """hourly AS (
  SELECT b.geo_location, h.a AS avg_users_per_hour, h.m AS max_users_per_hour,
    coalesce(h.a, 0) / (avg(h.a) OVER () + 1e-10) AS user_cv,
    b.unique_users / CAST(greatest(b.active_hours, 1) AS DOUBLE) AS users_per_active_hour,
    b.unique_projects / CAST(greatest(b.unique_users, 1) AS DOUBLE) AS projects_per_user
  FROM base b LEFT JOIN (
    SELECT geo_location, avg(u) AS a, max(u) AS m FROM (
      SELECT geo_location, date_trunc('hour', ts) AS h, count(DISTINCT usr) AS u
      FROM vy GROUP BY 1, 2) GROUP BY 1) h USING (geo_location))"""

PROJECT = """project AS (
  SELECT geo_location,
    CAST(sum(CASE WHEN r = 1 THEN n END) AS DOUBLE) / sum(n) AS top_project_concentration,
    CAST(sum(CASE WHEN r <= 3 THEN n END) AS DOUBLE) / sum(n) AS top3_project_concentration,
    sum(power(CAST(n AS DOUBLE) / t, 2)) AS project_hhi
  FROM (SELECT geo_location, n, row_number() OVER (PARTITION BY geo_location ORDER BY n DESC, accession) AS r,
          sum(n) OVER (PARTITION BY geo_location) AS t
        FROM (SELECT geo_location, accession, count(*) AS n FROM vy
              WHERE accession IS NOT NULL GROUP BY 1, 2))
  GROUP BY geo_location)"""

YEARLY = """yc AS (SELECT geo_location, year, count(*) AS n FROM vy GROUP BY 1, 2),
years AS (SELECT DISTINCT year FROM yc),
ygrid AS (
  SELECT l.geo_location, y.year, coalesce(c.n, 0) AS n,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY l.geo_location) AS t
  FROM (SELECT DISTINCT geo_location FROM yc) l, years y
  LEFT JOIN yc c ON c.geo_location = l.geo_location AND c.year = y.year),
ysm AS (
  SELECT *, CAST(n AS DOUBLE) / t AS p,
    (CAST(n AS DOUBLE) / t + 1e-10) / (1 + 1e-10 * (SELECT count(*) FROM years)) AS q FROM ygrid),
yearly AS (
  SELECT geo_location, -sum(q * ln(q)) AS yearly_entropy, max(p) AS peak_year_concentration,
    count(CASE WHEN n > 0 THEN 1 END) AS years_span,
    CAST(max(t) AS DOUBLE) / count(CASE WHEN n > 0 THEN 1 END) AS downloads_per_year,
    CASE WHEN count(CASE WHEN n > 0 THEN 1 END) > 1
      THEN stddev_samp(p) / (avg(p) + 1e-10) ELSE 0 END AS year_over_year_cv,
    CAST(sum(CASE WHEN year = ly THEN n ELSE 0 END) AS DOUBLE) / max(t) AS fraction_latest_year,
    CASE WHEN min(CASE WHEN n > 0 THEN year END) = max(ly)
      AND count(CASE WHEN n > 0 THEN 1 END) = 1 THEN 1 ELSE 0 END AS is_new_location,
    CASE WHEN coalesce(sum(CASE WHEN year < ly THEN n END), 0) > 0
      THEN sum(CASE WHEN year = ly THEN n ELSE 0 END) /
        (CAST(sum(CASE WHEN year < ly THEN n END) AS DOUBLE)
         / greatest(count(CASE WHEN year < ly AND n > 0 THEN 1 END), 1) + 1e-10)
      ELSE sum(CASE WHEN year = ly THEN n ELSE 0 END) / 1000.0 END AS spike_ratio,
    count(CASE WHEN year < ly AND n > 0 THEN 1 END) AS years_before_latest,
    sum(CASE WHEN year = ly THEN n ELSE 0 END) AS latest_year_downloads
  FROM (SELECT *, (SELECT max(year) FROM years) AS ly FROM ysm) GROUP BY geo_location)"""

TIME_OF_DAY = """tod AS (
  SELECT l.geo_location, h.hod, coalesce(c.n, 0) AS n,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY l.geo_location) AS t
  FROM (SELECT DISTINCT geo_location FROM vy) l, (SELECT unnest(range(24)) AS hod) h
  LEFT JOIN (SELECT geo_location, hour(ts) AS hod, count(*) AS n FROM vy GROUP BY 1, 2) c
    ON c.geo_location = l.geo_location AND c.hod = h.hod),
time_of_day AS (
  SELECT geo_location, stddev_pop(n) AS hourly_download_std,
    max(CAST(n AS DOUBLE) / t) AS peak_hour_concentration,
    CAST(sum(CASE WHEN hod >= 9 AND hod < 17 THEN n ELSE 0 END) AS DOUBLE) / max(t) AS working_hours_ratio,
    -sum((CAST(n AS DOUBLE) / t + 1e-10) / (1 + 24e-10) * ln((CAST(n AS DOUBLE) / t + 1e-10) / (1 + 24e-10))) AS hourly_entropy,
    CAST(sum(CASE WHEN hod >= 22 OR hod < 6 THEN n ELSE 0 END) AS DOUBLE) / max(t) AS night_activity_ratio
  FROM tod GROUP BY geo_location)"""

COUNTRY = """cstat AS (
  SELECT country, count(*) AS locations_per_country, sum(latest_year_downloads) AS country_latest_year_dl,
    sum(total_downloads) AS country_total_dl, avg(fraction_latest_year) AS country_avg_fraction_latest,
    sum(is_new_location) AS country_new_locations,
    count(CASE WHEN spike_ratio > 1.5 THEN 1 END) AS country_high_spike_locations,
    count(CASE WHEN downloads_per_user < 30 THEN 1 END) AS country_low_dl_user_locations,
    sum(unique_users) AS country_total_users
  FROM base JOIN yearly USING (geo_location) GROUP BY country),
country_rollup AS (
  SELECT b.geo_location, c.* EXCLUDE (country),
    CAST(country_latest_year_dl AS DOUBLE) / country_total_dl AS country_fraction_latest,
    CAST(country_new_locations AS DOUBLE) / locations_per_country AS country_new_location_ratio,
    CAST(country_high_spike_locations + country_low_dl_user_locations AS DOUBLE)
      / (2 * locations_per_country) AS country_suspicious_location_ratio
  FROM base b JOIN cstat c USING (country))"""

PROTOCOL = """protocol AS (
  SELECT *, aspera_ratio * 0.9e0 + globus_ratio * 0.95e0 + ftp_ratio * 0.6e0 + http_ratio * 0.1e0 AS protocol_legitimacy_score
  FROM (SELECT geo_location,
    CAST(count(CASE WHEN lower(method) = 'http' THEN 1 END) AS DOUBLE) / count(*) AS http_ratio,
    CAST(count(CASE WHEN lower(method) = 'ftp' THEN 1 END) AS DOUBLE) / count(*) AS ftp_ratio,
    CAST(count(CASE WHEN lower(method) LIKE '%aspera%' THEN 1 END) AS DOUBLE) / count(*) AS aspera_ratio,
    CAST(count(CASE WHEN lower(method) LIKE '%globus%' THEN 1 END) AS DOUBLE) / count(*) AS globus_ratio,
    count(DISTINCT method) AS protocol_diversity FROM vy GROUP BY geo_location))"""

WINDOWS = """wc AS (
  SELECT geo_location, CAST(date_trunc('{p}', ts) AS TIMESTAMP) AS window_start, count(*) AS dl, count(DISTINCT usr) AS us
  FROM vy GROUP BY 1, 2),
wt AS (
  SELECT *, dl / CAST(us AS DOUBLE) AS raw_dpu, count(*) OVER (PARTITION BY geo_location) AS k,
    row_number() OVER (PARTITION BY geo_location ORDER BY window_start) AS i
  FROM (SELECT *, row_number() OVER (PARTITION BY geo_location ORDER BY window_start DESC) AS b FROM wc)
  WHERE b <= 12),
wd AS (SELECT *, CASE WHEN us = 0 THEN 0 ELSE raw_dpu END AS dpu FROM wt),
wf AS (
  SELECT geo_location, window_start, i + 12 - k AS pos, CAST(dl AS DOUBLE) AS downloads, CAST(us AS DOUBLE) AS users,
    dpu AS downloads_per_user,
    coalesce(dl / NULLIF(CAST(lag(dl) OVER w AS DOUBLE), 0) - 1, 0) AS downloads_change,
    coalesce(us / NULLIF(CAST(lag(us) OVER w AS DOUBLE), 0) - 1, 0) AS users_change,
    coalesce(dpu / NULLIF(lag(dpu) OVER w, 0) - 1, 0) AS downloads_per_user_change,
    CAST(min(dl) OVER w3 AS DOUBLE) AS rolling_min, CAST(max(dl) OVER w3 AS DOUBLE) AS rolling_max,
    coalesce(stddev_samp(dl) OVER w3, 0) AS rolling_std, median(dl) OVER w3 AS rolling_median,
    CASE WHEN i < least(k, 3) THEN 0 ELSE coalesce(regr_slope(dl, i) OVER w3, 0) END AS slope,
    CASE WHEN i < least(k, 3) THEN 0 ELSE (stddev_pop(dl) OVER w3) / (avg(dl) OVER w3) END AS volatility
  FROM wd WINDOW w AS (PARTITION BY geo_location ORDER BY window_start),
    w3 AS (PARTITION BY geo_location ORDER BY window_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
wg AS (
  SELECT l.geo_location, p.pos, {zero}
  FROM (SELECT DISTINCT geo_location FROM wc) l, (SELECT unnest(range(1, 13)) AS pos) p
  LEFT JOIN wf f ON f.geo_location = l.geo_location AND f.pos = p.pos)"""
WINDOW_COLS = ("downloads users downloads_per_user downloads_change users_change "
               "downloads_per_user_change rolling_min rolling_max rolling_std rolling_median "
               "slope volatility").split()


def windows(period: str) -> str:
    zero = ", ".join(f"coalesce(f.{c}, 0) AS {c}" for c in WINDOW_COLS)
    return WINDOWS.format(p=period, zero=zero)


SAMPLE = """smp AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY geo_location ORDER BY sample_key) AS sample_rank
    FROM (SELECT *, md5(concat_ws('|', CAST(epoch_us(ts) AS VARCHAR), accession, filename, usr)) AS sample_key FROM v))
  WHERE sample_rank <= {k}),
gaps AS (
  SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY geo_location ORDER BY ts, sample_key)) / 1e6 AS gap FROM smp)"""

_MOMENTS = """,
regularity AS (
  SELECT geo_location, avg(gap) AS mean_interval, stddev_samp(gap) AS std_interval,
    coalesce(CASE WHEN avg(gap) > 0 THEN stddev_samp(gap) / avg(gap) ELSE 1 END, 1) AS interval_cv,
    CASE WHEN stddev_samp(gap) > 0 THEN avg(gap) / (stddev_samp(gap) + 1) ELSE 0 END AS regularity_score
  FROM gaps WHERE gap > 0 GROUP BY 1)"""
REGULARITY = SAMPLE.format(k=50) + _MOMENTS
WHOLE_REGULARITY = """gaps AS (
  SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY geo_location ORDER BY ts)) / 1e6 AS gap FROM v)""" + _MOMENTS

DOW = """dow AS (
  SELECT geo_location, avg(CASE WHEN dayofweek(ts) IN (0, 6) THEN 1.0 ELSE 0.0 END) AS weekend_ratio,
    count(DISTINCT dayofweek(ts)) AS unique_days_of_week FROM v GROUP BY 1)"""

FILE_DIV = """filediv AS (
  SELECT geo_location, count(DISTINCT filename) AS unique_files,
    1.0 / NULLIF(count(DISTINCT filename), 0) AS file_concentration,
    CAST(count(DISTINCT filename) AS DOUBLE) / count(*) AS file_diversity_ratio
  FROM log WHERE geo_location IS NOT NULL GROUP BY 1)"""

SESSION_ROWS = """srow AS (
  SELECT geo_location, ts, lag(ts) OVER (PARTITION BY geo_location ORDER BY ts) AS prev FROM v),
smark AS (
  SELECT *, CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 1800000000 THEN 1 ELSE 0 END AS st,
    CASE WHEN epoch_us(ts) - epoch_us(prev) > 1800000000 THEN (epoch_us(ts) - epoch_us(prev)) / 1e6 END AS gap FROM srow)"""

SESSION_COUNT = SESSION_ROWS + """,
sesscount AS (
  SELECT geo_location, sum(CASE WHEN gap IS NOT NULL THEN 1 ELSE 0 END) + 1 AS num_sessions,
    CAST(count(*) AS DOUBLE) / (sum(CASE WHEN gap IS NOT NULL THEN 1 ELSE 0 END) + 1) AS downloads_per_session
  FROM smark GROUP BY 1)"""

SESSIONS = """sid AS (SELECT *, sum(st) OVER (PARTITION BY geo_location ORDER BY ts) AS session_id FROM smark),
sess AS (
  SELECT geo_location, session_id, min(hour(ts)) AS start_hour, count(*) AS downloads,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration FROM sid GROUP BY 1, 2),
sent AS (
  SELECT geo_location, -sum(c / t * log2(c / t + 1e-10)) AS ent FROM (
    SELECT geo_location, start_hour, CAST(count(*) AS DOUBLE) AS c,
      CAST(sum(count(*)) OVER (PARTITION BY geo_location) AS DOUBLE) AS t FROM sess GROUP BY 1, 2) GROUP BY 1),
sgap AS (
  SELECT geo_location, CASE WHEN stddev_samp(gap) > 0 THEN avg(gap) / stddev_samp(gap) ELSE 0 END AS reg
  FROM smark WHERE gap IS NOT NULL GROUP BY 1),
session_behaviour AS (
  SELECT s.geo_location,
    CASE WHEN s.dm > 0 THEN s.ds / s.dm ELSE 0 END AS session_duration_cv,
    coalesce(g.reg, 0) AS inter_session_regularity,
    CASE WHEN s.sm > 0 THEN s.ss / s.sm ELSE 0 END AS downloads_per_session_cv,
    e.ent AS session_start_hour_entropy
  FROM (SELECT geo_location, avg(duration) AS dm, stddev_samp(duration) AS ds, avg(downloads) AS sm,
          stddev_samp(downloads) AS ss, count(*) AS k FROM sess GROUP BY 1) s
  LEFT JOIN sgap g USING (geo_location) LEFT JOIN sent e USING (geo_location) WHERE s.k >= 2)"""

BURST = """burst AS (
  SELECT geo_location, CASE WHEN stddev_samp(n) > 0 THEN (max(n) - avg(n)) / stddev_samp(n) ELSE 0 END AS burst_pattern_score,
    CASE WHEN avg(n) > 0 THEN stddev_samp(n) / avg(n) ELSE 0 END AS hourly_cv_burst,
    CASE WHEN avg(n) > 0 THEN max(n) / avg(n) ELSE 1 END AS spike_intensity
  FROM hr GROUP BY 1 HAVING count(*) > 1)"""

CIRCADIAN = """circ AS (
  SELECT geo_location, avg(CASE WHEN hour(ts) BETWEEN 0 AND 5 THEN 1.0 ELSE 0 END) AS night_ratio_advanced,
    avg(CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 1.0 ELSE 0 END) AS work_ratio_advanced,
    avg(CASE WHEN hour(ts) BETWEEN 18 AND 23 THEN 1.0 ELSE 0 END) AS evening_ratio,
    avg(CASE WHEN hour(ts) BETWEEN 6 AND 8 THEN 1.0 ELSE 0 END) AS morning_ratio FROM v GROUP BY 1),
circadian AS (
  SELECT *, abs(night_ratio_advanced - 0.10) + abs(work_ratio_advanced - 0.50)
    + abs(evening_ratio - 0.25) + abs(morning_ratio - 0.15) AS circadian_rhythm_deviation FROM circ)"""

COORD = """coord AS (
  SELECT geo_location, stddev_samp(u) AS user_coordination_std, avg(u) AS avg_concurrent_users,
    max(u) AS max_concurrent_users,
    CASE WHEN stddev_samp(u) > 0 THEN avg(u) / stddev_samp(u) ELSE 0 END AS user_coordination_score,
    CASE WHEN avg(u) > 0 THEN max(u) / avg(u) ELSE 1 END AS user_peak_ratio
  FROM hr WHERE u > 0 GROUP BY 1 HAVING count(*) > 1)"""

PRECISION = SAMPLE.format(k=100) + """,
gok AS (SELECT *, round(gap / 10) * 10 AS gm FROM gaps WHERE gap > 0 AND gap < 86400),
gmode AS (
  SELECT geo_location, gm FROM (
    SELECT geo_location, gm, row_number() OVER (PARTITION BY geo_location ORDER BY count(*) DESC, gm) AS r
    FROM gok GROUP BY 1, 2) WHERE r = 1),
precision AS (
  SELECT geo_location, any_value(m.gm) AS request_interval_mode,
    avg(CASE WHEN second(ts) IN (0, 15, 30, 45) THEN 1.0 ELSE 0.0 END) AS round_second_ratio,
    var_samp(millisecond(ts)) AS millisecond_variance,
    CASE WHEN avg(gap) > 0 AND stddev_samp(gap) IS NOT NULL
      THEN log2(greatest(stddev_samp(gap) / avg(gap) + 1, 1)) ELSE 1 END AS interval_entropy
  FROM gok JOIN gmode m USING (geo_location) GROUP BY 1 HAVING count(*) >= 5)"""

USERS = """uc AS (SELECT geo_location, usr, count(*) AS n FROM log WHERE geo_location IS NOT NULL AND usr IS NOT NULL GROUP BY 1, 2),
ur AS (
  SELECT *, row_number() OVER (PARTITION BY geo_location ORDER BY n, usr) AS asc_r,
    row_number() OVER (PARTITION BY geo_location ORDER BY n DESC, usr) AS desc_r,
    sum(n) OVER (PARTITION BY geo_location) AS t, count(*) OVER (PARTITION BY geo_location) AS k FROM uc),
userdist AS (
  SELECT geo_location, -sum(CAST(n AS DOUBLE) / t * log2(CAST(n AS DOUBLE) / t + 1e-10)) AS user_entropy,
    CASE WHEN max(k) < 2 THEN 0.5 ELSE
      2 * sum(CAST(asc_r * n AS DOUBLE)) / (max(k) * CAST(max(t) AS DOUBLE)) - (max(k) + 1) / CAST(max(k) AS DOUBLE) END AS user_gini_coefficient,
    avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS single_download_user_ratio,
    CAST(sum(CASE WHEN desc_r <= greatest(k / 10.0, 1) THEN n ELSE 0 END) AS DOUBLE) / max(t) AS power_user_ratio
  FROM ur GROUP BY 1)"""

OUTBURST = """dz AS (
  SELECT *, row_number() OVER (PARTITION BY geo_location ORDER BY day DESC) AS back, (n - m) / s AS z
  FROM (SELECT *, avg(n) OVER (PARTITION BY geo_location) AS m, stddev_samp(n) OVER (PARTITION BY geo_location) AS s FROM dy)
  WHERE s > 0),
outburst AS (
  SELECT geo_location, count(CASE WHEN abs(z) > 2 THEN 1 END) AS outburst_count,
    coalesce(avg(CASE WHEN z > 2 THEN z END), 0) AS outburst_intensity, max(z) AS max_outburst_zscore,
    coalesce(CAST(sum(CASE WHEN z > 2 THEN n ELSE 0 END) AS DOUBLE) / sum(n), 0) AS outburst_ratio,
    coalesce(CAST(min(CASE WHEN z > 2 THEN back END) AS DOUBLE) / max(back), 1) AS time_since_last_outburst
  FROM dz GROUP BY 1)"""

STREAK = """isl AS (
  SELECT geo_location, z, sum(CASE WHEN z > 2 THEN 0 ELSE 1 END) OVER (PARTITION BY geo_location ORDER BY day) AS g FROM dz),
streak AS (
  SELECT geo_location, max(c) AS longest_outburst_streak FROM (
    SELECT geo_location, g, count(*) AS c FROM isl WHERE z > 2 GROUP BY 1, 2) GROUP BY 1)"""

AUTOCORR = """ds AS (
  SELECT *, row_number() OVER (PARTITION BY geo_location ORDER BY day) AS i, count(*) OVER (PARTITION BY geo_location) AS k,
    avg(n) OVER (PARTITION BY geo_location) AS m, stddev_pop(n) OVER (PARTITION BY geo_location) AS s FROM dy),
autocorr AS (
  SELECT a.geo_location, CASE WHEN max(a.k) >= 14 AND max(a.s) > 0
    THEN coalesce(sum((a.n - a.m) / nullif(a.s, 0) * (b.n - b.m) / nullif(b.s, 0)), 0) / (max(a.k) - 7) ELSE 0 END AS weekly_autocorr
  FROM ds a LEFT JOIN ds b ON a.geo_location = b.geo_location AND b.i = a.i + 7 GROUP BY 1)"""

PERIOD = """dft AS (
  SELECT a.geo_location, f.f, max(a.k) AS k,
    power(sum((n - m) / s * cos(2 * pi() * f.f * (i - 1) / k)), 2)
    + power(sum((n - m) / s * sin(2 * pi() * f.f * (i - 1) / k)), 2) AS p
  FROM ds a, (SELECT unnest(range(2, 2000)) AS f) f WHERE f.f <= a.k // 2 AND a.k >= 14 AND a.s > 0 GROUP BY 1, 2),
dfr AS (
  SELECT *, row_number() OVER (PARTITION BY geo_location ORDER BY p DESC, f) AS r,
    count(*) OVER (PARTITION BY geo_location) AS c, sum(p) OVER (PARTITION BY geo_location) AS t FROM dft),
period AS (
  SELECT l.geo_location, coalesce(d.dominant_period_days, 0) AS dominant_period_days,
    coalesce(d.periodicity_strength, 0) AS periodicity_strength, coalesce(d.period_regularity, 0) AS period_regularity
  FROM (SELECT DISTINCT geo_location FROM dy) l LEFT JOIN (
    SELECT geo_location, max(CASE WHEN r = 1 THEN k / CAST(f AS DOUBLE) END) AS dominant_period_days,
      least(max(CASE WHEN r = 1 THEN p / (t + 1e-10) END), 1.0) AS periodicity_strength,
      CASE WHEN max(c) > 3 THEN least(max(CASE WHEN r = 1 THEN p END)
        / (avg(CASE WHEN r BETWEEN 2 AND 4 THEN p END) + 1e-10), 10.0) ELSE 1.0 END AS period_regularity
    FROM dfr GROUP BY 1) d USING (geo_location))"""

TREND = """wx AS (
  SELECT geo_location, CAST(n AS DOUBLE) AS y, CAST(row_number() OVER (PARTITION BY geo_location ORDER BY week) - 1 AS DOUBLE) AS x,
    CAST(count(*) OVER (PARTITION BY geo_location) AS DOUBLE) AS k FROM wk),
wfit AS (
  SELECT geo_location, max(k) AS k, avg(y) AS m, var_pop(y) AS vy, coalesce(regr_slope(y, x), 0) AS b,
    CASE WHEN var_pop(y) > 0 THEN regr_r2(y, x) ELSE 0 END AS r2,
    CASE WHEN max(k) >= 5 THEN sum(power(x - (k - 1) / 2, 2) * y - (k * k - 1) / 12 * y)
      / sum(power(power(x - (k - 1) / 2, 2) - (k * k - 1) / 12, 2)) ELSE 0 END AS a
  FROM wx GROUP BY 1),
trend AS (
  SELECT geo_location, CASE WHEN k < 4 THEN 0 ELSE greatest(least(b / (m + 1e-10), 10), -10) END AS trend_slope,
    CASE WHEN k < 4 THEN 0 ELSE r2 END AS trend_strength,
    CASE WHEN k < 4 THEN 0 ELSE greatest(least(2 * a / (m + 1e-10), 10), -10) END AS trend_acceleration,
    CASE WHEN k < 4 THEN 0 ELSE least(sqrt(greatest(vy * (1 - r2), 0)) / (m + 1e-10), 10) END AS detrended_volatility,
    CASE WHEN k < 4 OR abs(b / (m + 1e-10)) < 0.01 THEN 0 WHEN b > 0 THEN 1 ELSE -1 END AS trend_direction
  FROM wfit)"""

RECENCY = """rday AS (SELECT *, max(day) OVER (PARTITION BY geo_location) AS last FROM dy),
rst AS (
  SELECT geo_location, avg(n) AS hm, stddev_samp(n) AS hs, sum(n) AS t,
    avg(CASE WHEN day >= last - INTERVAL 30 DAY THEN n END) AS rm,
    stddev_samp(CASE WHEN day >= last - INTERVAL 30 DAY THEN n END) AS rs,
    sum(CASE WHEN day >= last - INTERVAL 30 DAY THEN n END) AS rt FROM rday GROUP BY 1),
recency AS (
  SELECT geo_location, CASE WHEN hm > 0 THEN rm / hm ELSE 1 END AS recent_activity_ratio,
    coalesce(CASE WHEN hs > 0 AND hm > 0 AND rm > 0 THEN (rs / rm) / (hs / hm) ELSE 1 END, 1) AS recent_volatility_ratio,
    CAST(rt AS DOUBLE) / t AS recency_concentration FROM rst)"""

MOMENTUM = """wb AS (SELECT geo_location, n, row_number() OVER (PARTITION BY geo_location ORDER BY week DESC) - 1 AS b FROM wk),
wm AS (
  SELECT geo_location, count(*) AS k, avg(CASE WHEN b < 3 THEN n END) AS r,
    CASE WHEN count(*) > 3 THEN avg(CASE WHEN b >= 3 THEN n END) ELSE sum(power(0.7, b) * n) / sum(power(0.7, b)) END AS h FROM wb GROUP BY 1),
momentum AS (
  SELECT geo_location, CASE WHEN k < 3 THEN 0 ELSE greatest(least((r - h) / (h + 1e-10), 5), -5) END AS momentum_score FROM wm)"""

SHAPE = """dm AS (SELECT geo_location, count(*) AS k, avg(n) AS m, var_pop(n) AS s2,
    quantile_cont(n, 0.5) AS md, quantile_cont(n, 0.99) AS p99,
    count(CASE WHEN n = 0 THEN 1 END) AS z FROM {day} GROUP BY 1),
d34 AS (SELECT d.geo_location, avg(power(d.n - dm.m, 3)) AS m3, avg(power(d.n - dm.m, 4)) AS m4
  FROM {day} d JOIN dm USING (geo_location) GROUP BY 1),
shape AS (
  SELECT geo_location, CASE WHEN k < 5 OR s2 = 0 THEN 0 ELSE greatest(least(m3 / power(s2, 1.5), 10), -10) END AS download_skewness,
    CASE WHEN k < 5 OR s2 = 0 THEN 0 ELSE greatest(least(m4 / (s2 * s2) - 3, 50), -10) END AS download_kurtosis,
    CASE WHEN k < 5 THEN 1 ELSE least(p99 / (md + 1e-10), 100) END AS tail_heaviness_ratio,
    CASE WHEN k < 5 THEN 0 ELSE CAST(z AS DOUBLE) / k END AS zero_day_ratio
  FROM dm JOIN d34 USING (geo_location))"""

CALENDAR = """cal AS (
  SELECT c.geo_location, c.day, coalesce(d.n, 0) AS n FROM (
    SELECT geo_location, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM dy GROUP BY geo_location) c
  LEFT JOIN dy d ON d.geo_location = c.geo_location AND d.day = c.day)"""

PROFILE = """hum AS (
  SELECT hod, hv / sum(hv) OVER () AS hv FROM (
    SELECT unnest(range(24)) AS hod, unnest([0.01, 0.005, 0.003, 0.002, 0.005, 0.01, 0.02, 0.04, 0.06, 0.07, 0.08, 0.08,
      0.07, 0.07, 0.08, 0.07, 0.06, 0.05, 0.04, 0.04, 0.04, 0.03, 0.02, 0.015]::DOUBLE[]) AS hv)),
hp AS (
  SELECT l.geo_location, h.hod, h.hv, coalesce(c.n, 0) / CAST(l.t AS DOUBLE) AS p
  FROM (SELECT geo_location, count(*) AS t FROM v GROUP BY 1) l, hum h
  LEFT JOIN (SELECT geo_location, hour(ts) AS hod, count(*) AS n FROM v GROUP BY 1, 2) c
    ON c.geo_location = l.geo_location AND c.hod = h.hod),
hq AS (
  SELECT *, (p + 1e-10) / (sum(p + 1e-10) OVER (PARTITION BY geo_location)) AS a,
    (hv + 1e-10) / (sum(hv + 1e-10) OVER (PARTITION BY geo_location)) AS b,
    lead(p) OVER (PARTITION BY geo_location ORDER BY hod) AS nx FROM hp),
hour_profile AS (
  SELECT geo_location,
    CASE WHEN var_pop(CASE WHEN nx IS NOT NULL THEN p END) > 0 AND var_pop(nx) > 0
      THEN covar_pop(p, nx) / sqrt(var_pop(CASE WHEN nx IS NOT NULL THEN p END) * var_pop(nx)) ELSE 0 END AS autocorrelation_lag1,
    sqrt(sum(a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2))) / 2) AS circadian_deviation,
    -sum(p * ln(p + 1e-10)) / ln(24) AS request_timing_entropy
  FROM hq GROUP BY 1)"""

FILE_ACCESS = """fc AS (SELECT geo_location, filename, count(*) AS n, count(DISTINCT usr) AS u FROM log
  WHERE geo_location IS NOT NULL AND filename IS NOT NULL GROUP BY 1, 2),
fe AS (
  SELECT geo_location, count(*) AS unique_files, avg(u) AS avg_users_per_file,
    -sum(CAST(n AS DOUBLE) / t * log2(CAST(n AS DOUBLE) / t)) AS file_entropy
  FROM (SELECT *, sum(n) OVER (PARTITION BY geo_location) AS t FROM fc) GROUP BY 1),
file_access AS (
  SELECT *, CASE WHEN unique_files > 10 THEN file_entropy * ln(unique_files + 1) ELSE 0 END AS file_exploration_score,
    CASE WHEN file_entropy > 0 THEN 1 / (file_entropy + 0.1) ELSE 10 END AS file_mirroring_score FROM fe)"""

FILE_COMPAT = """file_access AS (
  SELECT geo_location, uf AS unique_files, au AS avg_users_per_file, e AS file_entropy,
    CASE WHEN uf > 10 THEN e * ln(uf + 1) ELSE 0 END AS file_exploration_score,
    CASE WHEN e > 0 THEN 1.0 / (e + 0.1) ELSE 10 END AS file_mirroring_score
  FROM (SELECT geo_location, count(DISTINCT filename) AS uf, avg(u) AS au,
      log2(CAST(count(*) AS DOUBLE) / count(DISTINCT filename)) AS e FROM (
    SELECT geo_location, filename, count(DISTINCT usr) AS u FROM log
    WHERE geo_location IS NOT NULL AND filename IS NOT NULL GROUP BY 1, 2) GROUP BY 1))"""

AUTHENTIC = """ua AS (
  SELECT geo_location, usr, count(*) AS n, count(DISTINCT filename) AS f, count(DISTINCT date_trunc('day', ts)) AS d
  FROM log WHERE geo_location IS NOT NULL AND usr IS NOT NULL AND filename IS NOT NULL GROUP BY 1, 2),
uh AS (
  SELECT geo_location, count(*) AS k, CASE WHEN stddev_samp(n) > 0 THEN avg(n) / stddev_samp(n) ELSE 0 END AS user_homogeneity_score,
    avg(d) AS avg_active_days_per_user, avg(f) AS avg_files_per_user FROM ua GROUP BY 1),
authentic AS (
  SELECT *, CASE WHEN k > {farm} AND user_homogeneity_score > {hom} THEN user_homogeneity_score * ln(k + 1) ELSE 0 END AS bot_farm_score,
    avg_active_days_per_user * avg_files_per_user AS user_authenticity_score FROM uh)"""

VERSION = """version AS (
  SELECT geo_location, count(DISTINCT ver) AS unique_versions, 1.0 / count(DISTINCT ver) AS version_concentration,
    CASE WHEN 1.0 / count(DISTINCT ver) > 0.5 THEN 1 ELSE 0 END AS targets_latest_only
  FROM (SELECT geo_location, regexp_extract(filename, '[0-9]+\\.[0-9]+\\.[0-9]+', 0) AS ver FROM log
        WHERE geo_location IS NOT NULL AND filename IS NOT NULL) WHERE ver <> '' GROUP BY 1)"""

PERSISTENCE = """persistence AS (
  SELECT *, CASE WHEN lifespan_days > 0 THEN active_days / lifespan_days ELSE 1 END AS activity_density,
    active_weeks * active_days AS persistence_score
  FROM (SELECT geo_location, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6 AS lifespan_days,
    count(DISTINCT date_trunc('day', ts)) AS active_days, count(DISTINCT date_trunc('week', ts)) AS active_weeks
    FROM v GROUP BY 1))"""

REPEAT = """repeats AS (
  SELECT geo_location, CAST(count(CASE WHEN n > 1 THEN 1 END) AS DOUBLE) / count(*) AS retry_ratio,
    CAST(count(*) AS DOUBLE) / sum(n) AS unique_file_ratio
  FROM (SELECT geo_location, filename, count(*) AS n FROM v WHERE filename IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""

ACCESS_ORDER = """ao AS (
  SELECT geo_location, filename, row_number() OVER (PARTITION BY geo_location ORDER BY ts, accession, filename, usr) AS a,
    dense_rank() OVER (PARTITION BY geo_location ORDER BY filename) AS b,
    regexp_extract(filename, '([0-9]+)', 1) AS fno
  FROM v WHERE filename IS NOT NULL)"""

SEQUENTIAL = ACCESS_ORDER + """,
sequential AS (
  SELECT l.geo_location, coalesce(s.r, 0) AS sequential_file_ratio
  FROM (SELECT DISTINCT geo_location FROM ao) l LEFT JOIN (
    SELECT x.geo_location, avg(CASE WHEN abs(TRY_CAST(x.fno AS INTEGER) - TRY_CAST(y.fno AS INTEGER)) = 1 THEN 1.0 ELSE 0.0 END) AS r
    FROM ao x JOIN ao y ON x.geo_location = y.geo_location AND y.a = x.a + 1 WHERE x.fno <> '' GROUP BY 1) s USING (geo_location))"""

ALPHA = """alpha AS (
  SELECT geo_location, s AS alphabetical_access_score, s * f / n AS directory_traversal_score FROM (
    SELECT geo_location, CASE WHEN stddev_samp(a) > 0 AND stddev_samp(b) > 0
      THEN (avg(CAST(a AS DOUBLE) * b) - avg(a) * avg(b)) / (stddev_samp(a) * stddev_samp(b)) ELSE 0 END AS s,
      count(DISTINCT filename) AS f, CAST(count(*) AS DOUBLE) AS n FROM ao GROUP BY 1))"""

BENFORD = """bdig AS (SELECT geo_location, count(*) AS k, """ + ", ".join(
    f"avg(CASE WHEN left(CAST(n AS VARCHAR), 1) = '{d}' THEN 1.0 ELSE 0.0 END) AS p{d}"
    for d in range(1, 10)) + """ FROM dy GROUP BY 1),
benford AS (
  SELECT geo_location, CASE WHEN k < 10 THEN 0 ELSE """ + " + ".join(
    f"power(p{d} - {e}, 2) / ({e} + 0.01)" for d, e in enumerate(
        (0.301, 0.176, 0.125, 0.097, 0.079, 0.067, 0.058, 0.051, 0.046), 1)) + """ END AS benford_deviation FROM bdig)"""

UNIFORM = """uniformity AS (
  SELECT geo_location, greatest(least(coalesce(1 - var_samp(n) / (avg(n) * avg(n) + 0.01), 0), 1), 0) AS hourly_uniformity_score
  FROM (SELECT geo_location, hour(ts) AS h, count(*) AS n FROM v GROUP BY 1, 2) GROUP BY 1)"""

WEEKDAY = """weekday_pattern AS (
  SELECT geo_location, abs(avg(CASE WHEN dayofweek(ts) NOT IN (0, 6) THEN 1.0 ELSE 0.0 END) - 0.714) / 0.714 AS weekday_pattern_score
  FROM v GROUP BY 1)"""

SIGNATURE = """signature AS (
  SELECT geo_location, 1 / (hourly_entropy + 0.1) AS access_regularity,
    1 / (unique_users / (total_downloads + 1.0) + 0.01) AS ua_per_user,
    total_downloads / (working_hours_ratio * 168 + 1) AS request_velocity,
    1 - ln(1 + unique_users) / ln(2 + max(unique_users) OVER ()) AS ip_concentration,
    abs(downloads_per_user - med) / (med + 1) AS session_anomaly,
    1 / (downloads_per_user / (ln(1 + unique_users) + 1) + 0.1) AS request_pattern_anomaly,
    abs(working_hours_ratio - 0.5) AS weekend_weekday_imbalance
  FROM base JOIN time_of_day USING (geo_location), (SELECT median(downloads_per_user) AS med FROM base))"""


def norm(col: str, frm: str) -> str:
    lo = f"(SELECT quantile_cont(CAST({col} AS DOUBLE), 0.01) FROM {frm})"
    hi = f"(SELECT quantile_cont(CAST({col} AS DOUBLE), 0.99) FROM {frm})"
    return (f"CASE WHEN {hi} - {lo} < 1e-10 THEN 0 ELSE "
            f"greatest(least(({col} - {lo}) / ({hi} - {lo}), 1), 0) END")


def oracles() -> dict[str, str]:
    o = {}

    def add(key, source, ctes, cols, frm):
        o[key] = query(source, ctes, out("geo_location " + cols, frm))

    base_cols = ("country city unique_users:i total_downloads:i unique_projects:i active_hours:i "
                 "years_active:i first_year:i last_year:i downloads_per_user:r")
    yearly_cols = ("yearly_entropy:r peak_year_concentration:r years_span:i downloads_per_year:r "
                   "year_over_year_cv:r fraction_latest_year:r is_new_location:i spike_ratio:r "
                   "years_before_latest:i latest_year_downloads:i")
    tod_cols = ("hourly_download_std:r peak_hour_concentration:r working_hours_ratio:r "
                "hourly_entropy:r night_activity_ratio:r")
    add("fe01_base_location_stats", "orders", [BASE], base_cols, "base")
    add("fe02_hourly_user_density", "orders", [BASE, HOURLY],
        "avg_users_per_hour:r max_users_per_hour:i user_cv:r users_per_active_hour:r projects_per_user:r", "hourly")
    add("fe03_project_concentration", "orders", [PROJECT],
        "top_project_concentration:r top3_project_concentration:r project_hhi:r", "project")
    add("fe04_yearly_pattern", "orders", [YEARLY], yearly_cols, "yearly")
    add("fe05_time_of_day", "events", [TIME_OF_DAY], tod_cols, "time_of_day")
    add("fe06_country_rollup", "orders", [BASE, YEARLY, COUNTRY],
        "locations_per_country:i country_latest_year_dl:i country_total_dl:i country_avg_fraction_latest:r "
        "country_new_locations:i country_high_spike_locations:i country_low_dl_user_locations:i "
        "country_total_users:i country_fraction_latest:r country_new_location_ratio:r "
        "country_suspicious_location_ratio:r", "country_rollup")
    add("fe07_protocol_mix", "orders", [PROTOCOL],
        "http_ratio:r ftp_ratio:r aspera_ratio:r globus_ratio:r protocol_diversity:i protocol_legitimacy_score:r", "protocol")
    seq = " ".join(["pos:i"] + [f"{c}:r" for c in WINDOW_COLS])
    add("fe08_monthly_sequence", "orders", [windows("month")], seq, "wg")
    add("fe08_weekly_sequence", "events", [windows("week")], seq, "wg")
    add("fe09_interval_regularity", "events", [REGULARITY],
        "mean_interval:3 std_interval:3 interval_cv:r regularity_score:r", "regularity")
    add("fe10_day_of_week", "orders", [DOW], "weekend_ratio:r unique_days_of_week:i", "dow")
    add("fe11_file_diversity", "orders", [FILE_DIV],
        "unique_files:i file_concentration:r file_diversity_ratio:r", "filediv")
    add("fe12_session_counts", "events", [SESSION_COUNT],
        "num_sessions:i downloads_per_session:r", "sesscount")
    o["fe13_behaviour_flags"] = query("events", [REGULARITY, DOW, FILE_DIV, SESSION_COUNT, """allf AS (
      SELECT geo_location, coalesce(regularity_score, 0) AS regularity_score, weekend_ratio, file_diversity_ratio, downloads_per_session
      FROM dow JOIN filediv USING (geo_location) JOIN sesscount USING (geo_location) LEFT JOIN regularity USING (geo_location))"""],
        """SELECT geo_location,
        CAST(regularity_score > (SELECT quantile_cont(regularity_score, 0.75) FROM allf) AS DOUBLE) AS is_mechanical,
        CAST(weekend_ratio < 0.15 AS DOUBLE) AS is_weekday_biased, CAST(file_diversity_ratio < 0.1 AS DOUBLE) AS is_single_file,
        CAST(downloads_per_session > (SELECT quantile_cont(downloads_per_session, 0.75) FROM allf) AS DOUBLE) AS is_bursty FROM allf""")
    add("fe14_burst_pattern", "events", [BURST],
        "burst_pattern_score:r hourly_cv_burst:r spike_intensity:r", "burst")
    add("fe15_circadian_deviation", "events", [CIRCADIAN],
        "night_ratio_advanced:r work_ratio_advanced:r evening_ratio:r morning_ratio:r circadian_rhythm_deviation:r", "circadian")
    add("fe16_user_coordination", "events", [COORD],
        "user_coordination_std:r avg_concurrent_users:r max_concurrent_users:i user_coordination_score:r user_peak_ratio:r", "coord")
    o["fe17_advanced_flags"] = query("events", [BURST, CIRCADIAN, COORD, """allf AS (
      SELECT geo_location, coalesce(burst_pattern_score, 0) AS b, night_ratio_advanced AS nr, coalesce(user_coordination_score, 0) AS c
      FROM circadian LEFT JOIN burst USING (geo_location) LEFT JOIN coord USING (geo_location))"""],
        """SELECT geo_location, CAST(b > (SELECT quantile_cont(b, 0.75) FROM allf) AS DOUBLE) AS is_bursty_advanced,
        CAST(nr > 0.25 AS DOUBLE) AS is_nocturnal, CAST(c > (SELECT quantile_cont(c, 0.75) FROM allf) AS DOUBLE) AS is_coordinated FROM allf""")
    o["fe18_interaction_features"] = query("events", [BASE, TIME_OF_DAY, """i0 AS (
      SELECT geo_location, downloads_per_user AS dpu, unique_users AS u, working_hours_ratio - 0.5 AS anomaly_score, hourly_entropy
      FROM base JOIN time_of_day USING (geo_location)),
    i1 AS (SELECT geo_location, dpu / ln(u + 2) AS dl_user_per_log_users, CASE WHEN dpu > 20 THEN exp(-u / 100.0) ELSE 0 END AS user_scarcity_score,
      dpu / (u + 1) AS download_concentration, 1 / (hourly_entropy + 0.1) * ln(dpu + 1) AS temporal_irregularity,
      greatest(least(anomaly_score + 0.5, 1), 0) * dpu AS anomaly_dl_interaction,
      greatest(least(anomaly_score + 0.5, 1), 0) AS aw FROM i0),
    i2 AS (SELECT *, (0.3e0 * least(dl_user_per_log_users / (SELECT quantile_cont(dl_user_per_log_users, 0.95) FROM i1), 1)
      + 0.25e0 * user_scarcity_score + 0.25e0 * least(download_concentration / (SELECT quantile_cont(download_concentration, 0.95) FROM i1), 1)
      + 0.2e0 * aw) / (0.3e0 + 0.25e0 + 0.25e0 + 0.2e0) AS bot_composite_score FROM i1)"""],
        out("geo_location dl_user_per_log_users:r user_scarcity_score:r download_concentration:r temporal_irregularity:r "
            "anomaly_dl_interaction:r bot_composite_score:r", "i2"))
    add("fe19_timing_precision", "events", [PRECISION],
        "request_interval_mode:r round_second_ratio:r millisecond_variance:1 interval_entropy:r", "precision")
    ud = "user_entropy:r user_gini_coefficient:r single_download_user_ratio:r power_user_ratio:r"
    add("fe20_user_distribution", "orders", [USERS], ud, "userdist")
    add("fe21_session_behaviour", "events", [SESSION_ROWS, SESSIONS],
        "session_duration_cv:r inter_session_regularity:r downloads_per_session_cv:r session_start_hour_entropy:r",
        "session_behaviour")
    sig = ("access_regularity:r ua_per_user:r request_velocity:r ip_concentration:r session_anomaly:r "
           "request_pattern_anomaly:r weekend_weekday_imbalance:r")
    add("fe22_signature_features", "orders", [BASE, TIME_OF_DAY, SIGNATURE], sig, "signature")
    add("fe23_outbursts", "orders", [OUTBURST],
        "outburst_count:i outburst_intensity:r max_outburst_zscore:r outburst_ratio:r time_since_last_outburst:r", "outburst")
    add("fe24_outburst_streak", "orders", [OUTBURST, STREAK], "longest_outburst_streak:i", "streak")
    add("fe25_weekly_autocorrelation", "orders", [AUTOCORR], "weekly_autocorr:r", "autocorr")
    add("fe25_dominant_period", "events", [AUTOCORR, PERIOD],
        "dominant_period_days:r periodicity_strength:r period_regularity:r", "period")
    add("fe26_trend", "orders", [TREND],
        "trend_slope:r trend_strength:r trend_acceleration:r detrended_volatility:r trend_direction:i", "trend")
    add("fe27_recency", "orders", [RECENCY],
        "recent_activity_ratio:r recent_volatility_ratio:r recency_concentration:r", "recency")
    add("fe28_momentum", "orders", [MOMENTUM], "momentum_score:r", "momentum")
    sh = "download_skewness:r download_kurtosis:r tail_heaviness_ratio:r zero_day_ratio:r"
    add("fe29_distribution_shape", "orders", [SHAPE.format(day="dy")], sh, "shape")
    add("fe29_distribution_shape_calendar", "orders", [CALENDAR, SHAPE.format(day="cal")], sh, "shape")
    add("fe30_hour_profile", "orders", [PROFILE],
        "autocorrelation_lag1:r circadian_deviation:r request_timing_entropy:r", "hour_profile")
    fa = "unique_files:i file_entropy:r avg_users_per_file:r file_exploration_score:r file_mirroring_score:r"
    add("fe31_file_access", "orders", [FILE_ACCESS], fa, "file_access")
    add("fe31_file_access_compat", "orders", [FILE_COMPAT], fa, "file_access")
    au = ("user_homogeneity_score:r avg_active_days_per_user:r avg_files_per_user:r bot_farm_score:r user_authenticity_score:r")
    add("fe32_user_authenticity", "orders", [AUTHENTIC.format(farm=100, hom=1.5)], au, "authentic")
    add("fe33_geographic_stability", "orders", [BASE, TIME_OF_DAY, SIGNATURE,
        "stab AS (SELECT geo_location, greatest(least(1 / (ip_concentration + 0.1), 1), 0) AS geographic_stability FROM signature)"],
        "geographic_stability:r", "stab")
    add("fe34_version_targeting", "orders", [VERSION],
        "unique_versions:i version_concentration:r targets_latest_only:i", "version")
    add("fe35_persistence", "orders", [PERSISTENCE],
        "lifespan_days:r active_days:i active_weeks:i activity_density:r persistence_score:i", "persistence")
    add("fe36_robust_scaling", "orders", [FILE_ACCESS, f"nrm AS (SELECT geo_location, {norm('file_exploration_score', 'file_access')} AS file_exploration_scaled FROM file_access)"],
        "file_exploration_scaled:r", "nrm")
    o["fe37_discriminative_scores"] = query("orders", [
        BASE, TIME_OF_DAY, SIGNATURE, PROTOCOL, FILE_ACCESS, AUTHENTIC.format(farm=100, hom=1.5), VERSION, PERSISTENCE,
        """j AS (SELECT b.geo_location, file_exploration_score, bot_farm_score, file_mirroring_score, user_authenticity_score,
          persistence_score, targets_latest_only, activity_density, protocol_legitimacy_score,
          greatest(least(1 / (ip_concentration + 0.1), 1), 0) AS stab
          FROM base b JOIN signature USING (geo_location) JOIN protocol USING (geo_location) JOIN file_access USING (geo_location)
          JOIN authentic USING (geo_location) JOIN version USING (geo_location) JOIN persistence USING (geo_location))""",
        f"""sc AS (SELECT geo_location,
          least(greatest({norm('file_exploration_score', 'j')} * 0.25e0 + {norm('bot_farm_score', 'j')} * 0.30e0 + (1 - stab) * 0.20e0
            + targets_latest_only * 0.15e0 + (1 - greatest(least(activity_density, 1), 0)) * 0.10e0, 0), 1) AS malicious_bot_score,
          least(greatest({norm('file_mirroring_score', 'j')} * 0.30e0 + {norm('user_authenticity_score', 'j')} * 0.25e0 + stab * 0.20e0
            + {norm('persistence_score', 'j')} * 0.25e0 + greatest(least(protocol_legitimacy_score, 1), 0) * 0.15e0, 0), 1) AS legitimate_automation_score
          FROM j)""",
        """sd AS (SELECT *, malicious_bot_score - legitimate_automation_score AS bot_vs_legitimate_score FROM sc)"""],
        """SELECT geo_location, round(malicious_bot_score, 6) + 0.0 AS malicious_bot_score, round(legitimate_automation_score, 6) + 0.0 AS legitimate_automation_score,
          round(bot_vs_legitimate_score, 6) + 0.0 AS bot_vs_legitimate_score, CAST(bot_vs_legitimate_score > 0.3 AS DOUBLE) AS is_likely_malicious,
          CAST(bot_vs_legitimate_score < -0.3 AS DOUBLE) AS is_likely_legitimate_automation FROM sd""")
    add("fe38_repeat_access", "orders", [REPEAT], "retry_ratio:r unique_file_ratio:r", "repeats")
    add("fe39_sequential_access", "orders", [SEQUENTIAL], "sequential_file_ratio:r", "sequential")
    add("fe40_alphabetical_access", "orders", [ACCESS_ORDER, ALPHA],
        "alphabetical_access_score:r directory_traversal_score:r", "alpha")
    add("fe41_benford", "events", [BENFORD], "benford_deviation:r", "benford")
    add("fe42_hourly_uniformity", "events", [UNIFORM], "hourly_uniformity_score:r", "uniformity")
    add("fe43_weekday_pattern", "orders", [WEEKDAY], "weekday_pattern_score:r", "weekday_pattern")
    add("fe44_country_zscore", "orders", [BASE, """cz AS (
      SELECT geo_location, coalesce(CASE WHEN s > 0 THEN (downloads_per_user - m) / s END, 0) AS country_zscore FROM (
        SELECT *, avg(downloads_per_user) OVER (PARTITION BY country) AS m, stddev_samp(downloads_per_user) OVER (PARTITION BY country) AS s FROM base))"""],
        "country_zscore:r", "cz")
    add("fe45_trend_anomaly", "orders", [YEARLY, """ta AS (
      SELECT geo_location, CASE WHEN years_before_latest > 0 THEN ln(1 + spike_ratio) / ln(2 + years_before_latest) ELSE 0 END AS temporal_trend_anomaly FROM yearly)"""],
        "temporal_trend_anomaly:r", "ta")
    add("fe46_peer_similarity", "orders", [BASE, """ed AS (
      SELECT DISTINCT unnest(quantile_cont(CAST(unique_users AS DOUBLE), [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e FROM base),
    bn AS (SELECT *, (SELECT count(*) FROM ed WHERE e < unique_users AND e > (SELECT min(e) FROM ed)) AS bin FROM base),
    pm AS (SELECT *, median(downloads_per_user) OVER (PARTITION BY bin) AS md FROM bn),
    ps AS (SELECT geo_location, 1 / (1 + abs(downloads_per_user - md) / (md + 1)) AS peer_similarity FROM pm)"""],
        "peer_similarity:r", "ps")
    add("fe47_global_rank", "orders", [BASE, """gr AS (
      SELECT geo_location, ((rank() OVER (ORDER BY total_downloads)) + (count(*) OVER (PARTITION BY total_downloads) - 1) / 2.0)
        / count(*) OVER () AS global_rank_percentile FROM base)"""], "global_rank_percentile:r", "gr")
    flat = """flat AS (
      SELECT geo_location, min(country) AS country, count(*) AS total_downloads, count(DISTINCT usr) AS unique_users,
        count(DISTINCT accession) AS unique_projects, count(DISTINCT filename) AS unique_files,
        epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, count(DISTINCT hour(ts)) AS distinct_hours,
        count(DISTINCT year) AS years_active, min(year) AS first_year, max(year) AS last_year,
        sum(CASE WHEN method = 'http' THEN 1 ELSE 0 END) AS http_downloads, sum(CASE WHEN method = 'ftp' THEN 1 ELSE 0 END) AS ftp_downloads,
        sum(CASE WHEN method = 'fasp-aspera' THEN 1 ELSE 0 END) AS aspera_downloads,
        sum(CASE WHEN method = 'gridftp-globus' THEN 1 ELSE 0 END) AS globus_downloads,
        CAST(count(*) AS DOUBLE) / NULLIF(count(DISTINCT usr), 0) AS downloads_per_user,
        avg(CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 1.0 ELSE 0.0 END) AS working_hours_ratio,
        avg(CASE WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 1.0 ELSE 0.0 END) AS night_activity_ratio,
        avg(CASE WHEN dayofweek(ts) IN (0, 6) THEN 1.0 ELSE 0.0 END) AS weekend_ratio,
        CAST(count(DISTINCT filename) AS DOUBLE) / count(*) AS file_diversity_ratio,
        CAST(count(DISTINCT usr) AS DOUBLE) / NULLIF(count(DISTINCT accession), 0) AS users_per_project,
        CAST(count(DISTINCT accession) AS DOUBLE) / NULLIF(count(DISTINCT usr), 0) AS projects_per_user,
        count(*) / CAST(greatest(count(DISTINCT year), 1) AS DOUBLE) AS downloads_per_year,
        max(year) - min(year) + 1 AS years_span, ln(count(DISTINCT hour(ts))) / ln(24) AS hourly_entropy,
        avg(CASE WHEN method = 'http' THEN 1.0 ELSE 0.0 END) AS http_ratio, avg(CASE WHEN method = 'ftp' THEN 1.0 ELSE 0.0 END) AS ftp_ratio,
        avg(CASE WHEN method = 'fasp-aspera' THEN 1.0 ELSE 0.0 END) AS aspera_ratio,
        avg(CASE WHEN method = 'gridftp-globus' THEN 1.0 ELSE 0.0 END) AS globus_ratio
      FROM log WHERE geo_location IS NOT NULL GROUP BY geo_location HAVING count(*) >= 10)"""
    ints = "total_downloads:i unique_users:i unique_projects:i unique_files:i first_seen:i last_seen:i distinct_hours:i"
    add("fe48_flat_profile", "orders", [flat], "country " + ints + " years_active:i first_year:i last_year:i "
        "http_downloads:i ftp_downloads:i aspera_downloads:i globus_downloads:i downloads_per_user:r working_hours_ratio:r "
        "night_activity_ratio:r weekend_ratio:r file_diversity_ratio:r users_per_project:r projects_per_user:r "
        "downloads_per_year:r years_span:i hourly_entropy:r http_ratio:r ftp_ratio:r aspera_ratio:r globus_ratio:r", "flat")
    add("fe49_ground_truth_profile", "events", [flat], "country " + ints + " downloads_per_user:r working_hours_ratio:r "
        "night_activity_ratio:r weekend_ratio:r file_diversity_ratio:r", "flat")
    o["jn01_feature_join_defaults"] = query("orders", [BASE, PRECISION], """SELECT geo_location,
      CAST(total_downloads AS BIGINT) AS total_downloads, round(coalesce(request_interval_mode, 0), 6) + 0.0 AS request_interval_mode,
      round(coalesce(round_second_ratio, 0.25e0), 6) + 0.0 AS round_second_ratio,
      round(coalesce(millisecond_variance, 250000), 1) + 0.0 AS millisecond_variance,
      round(coalesce(interval_entropy, 1), 6) + 0.0 AS interval_entropy FROM base LEFT JOIN precision USING (geo_location)""")
    return o
