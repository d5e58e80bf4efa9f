"""DuckDB SQL for analytics, report tables and primitives."""

from __future__ import annotations

from logtide.catalogue_reports import COUNTRIES, FIRST, KEY, LAST
from logtide.functions import categories as cat
from logtide.plans.reports import IMPORTANCE, PROFILED
from oracles.base import out, query
from oracles.features import BASE, BURST, YEARLY, WINDOW_COLS, windows
from oracles.labels import FLAGSHIP_LABELS, LIGHT_LABELS

KINDS = ("bot", "hub", "user")
USERS = LIGHT_LABELS + ["ul AS (SELECT log.* FROM log WHERE geo_location IN (SELECT geo_location FROM lab WHERE NOT is_bot AND NOT is_hub))"]
HUBS = LIGHT_LABELS + ["hl AS (SELECT log.* FROM log WHERE geo_location IN (SELECT geo_location FROM lab WHERE is_hub))"]
NOBOTS = LIGHT_LABELS + ["nl AS (SELECT log.* FROM log WHERE geo_location NOT IN (SELECT geo_location FROM lab WHERE is_bot))"]
NAMED = ["nm AS (SELECT log.* REPLACE (list_extract([" + ", ".join(f"'{c}'" for c in COUNTRIES)
         + "], CAST(split_part(country, '_', 2) AS INTEGER) + 1) AS country) FROM log)"]


def lookup(col: str, groups: dict, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} IN ({', '.join(repr(m) for m in ms)}) THEN '{g}'"
                              for g, ms in groups.items()) + f" ELSE '{other}' END"


def file_type(col: str) -> str:
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"ends_with(lower({col}), '{s}')" for s in ss) + f" THEN '{g}'"
        for g, ss in cat.FILE_TYPES.items()) + " ELSE 'other' END"


WORLD = lookup("country", cat.WORLD_REGIONS, "Other")
REUSE = lookup("country", cat.REUSE_REGIONS, "Other")
DC = "dc AS (SELECT accession, count(*) AS downloads FROM {l} WHERE accession IS NOT NULL GROUP BY 1)"
DOWNLOADS = "CAST(sum(CASE WHEN {c} THEN total_downloads ELSE 0 END) AS BIGINT)"


def top(frm: str, k: int) -> str:
    return f"""SELECT accession, count(*) AS total_downloads, count(DISTINCT geo_location) AS unique_locations, count(DISTINCT country) AS unique_countries,
      min(year) AS first_download_year, max(year) AS last_download_year FROM {frm} WHERE accession IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k}"""


def oracles() -> dict[str, str]:
    o = {}

    def log(key, sql, ctes=(), source="orders"):
        o[key] = query(source, list(ctes), sql)

    def lab(key, sql, extra=()):
        log(key, sql, LIGHT_LABELS + list(extra))

    # ---- aggregation primitives
    log("agp01_counts_and_distincts", "SELECT country, count(*) AS n, count(DISTINCT usr) AS users, count(DISTINCT accession) AS projects, count(DISTINCT geo_location) AS locations FROM log GROUP BY 1")
    log("agp02_conditional", "SELECT country, count(CASE WHEN method = 'ftp' THEN 1 END) AS ftp, CAST(sum(CASE WHEN method = 'ftp' THEN hour(ts) ELSE 0 END) AS BIGINT) AS s, round(avg(CASE WHEN method = 'ftp' THEN hour(ts) END), 6) AS mean_hour FROM log GROUP BY 1")
    log("agp03_sample_deviation", "SELECT geo_location, CAST(year(week) AS BIGINT) AS y, count(*) AS weeks, round(stddev_samp(n), 6) AS sd, round(var_samp(n), 6) AS var FROM wk GROUP BY 1, 2")
    log("agp04_population_deviation", "SELECT geo_location, round(stddev_pop(n), 6) AS sd, round(var_pop(n), 6) AS var FROM wk GROUP BY 1")
    log("agp05_mode", "SELECT geo_location, m.method, h.hour FROM m JOIN h USING (geo_location)", [
        "m AS (SELECT geo_location, method FROM (SELECT geo_location, method, row_number() OVER (PARTITION BY geo_location ORDER BY count(*) DESC, method) AS r FROM log GROUP BY 1, 2) WHERE r = 1)",
        "h AS (SELECT geo_location, hr AS hour FROM (SELECT geo_location, hour(ts) AS hr, row_number() OVER (PARTITION BY geo_location ORDER BY count(*) DESC, hour(ts)) AS r FROM log GROUP BY 1, 2) WHERE r = 1)"])
    log("agp06_sorted_counts", "SELECT geo_location, string_agg(n || 'x' || c, ',' ORDER BY n) AS sorted_counts FROM (SELECT geo_location, n, count(*) AS c FROM (SELECT geo_location, usr, count(*) AS n FROM log GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1")
    log("agp07_percentiles", out("geo_location p01:r p25:r median:r p95:r p99:r", "q"), ["q AS (SELECT geo_location, quantile_cont(n, 0.01) AS p01, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99 FROM (SELECT geo_location, CAST(n AS DOUBLE) AS n FROM dy) GROUP BY 1)"])
    log("agp08_skew_kurtosis", "SELECT geo_location, round(avg(power(n - m, 3)) / power(avg(power(n - m, 2)), 1.5), 6) + 0.0 AS skew, round(avg(power(n - m, 4)) / power(avg(power(n - m, 2)), 2) - 3, 6) + 0.0 AS kurt FROM (SELECT *, avg(n) OVER (PARTITION BY geo_location) AS m FROM dy) GROUP BY 1")
    log("agp09_correlation_regression", "SELECT geo_location, round(corr(x, n), 6) + 0.0 AS corr, round(regr_slope(n, x), 6) + 0.0 AS slope, round(regr_intercept(n, x), 6) + 0.0 AS intercept FROM (SELECT *, row_number() OVER (PARTITION BY geo_location ORDER BY week) AS x FROM wk) GROUP BY 1")
    log("agp10_two_level", "SELECT country, round(avg(n), 6) AS mean, max(n) AS top, count(*) AS projects FROM (SELECT country, accession, count(*) AS n FROM log GROUP BY 1, 2) GROUP BY 1")
    log("agp11_pivot", "SELECT method AS protocol, " + ", ".join(f"count(CASE WHEN year = {y} THEN 1 END) AS y{y}" for y in range(FIRST, LAST + 1)) + " FROM log GROUP BY 1")
    log("agp12_multi_aggregate", "SELECT country, count(*) AS locations, CAST(sum(total_downloads) AS BIGINT) AS downloads, round(avg(downloads_per_user), 6) AS dpu, count(CASE WHEN total_downloads > 600 THEN 1 END) AS large FROM base GROUP BY 1", [BASE])
    log("agp13_window_over_aggregate", "SELECT geo_location, hour(ts) AS hour, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY geo_location) AS BIGINT) AS total FROM log GROUP BY 1, 2")
    log("agp15_city_names", "SELECT country, string_agg(city, ', ' ORDER BY city) AS cities FROM (SELECT country, city, row_number() OVER (PARTITION BY country ORDER BY city) AS i FROM (SELECT DISTINCT country, city FROM log)) WHERE i <= 3 GROUP BY 1")
    # ---- windows
    log("win01_row_numbers", "SELECT geo_location, epoch_us(day) AS day_us, n, row_number() OVER (PARTITION BY geo_location ORDER BY day) AS by_day, row_number() OVER (PARTITION BY geo_location ORDER BY day DESC) AS by_day_desc, row_number() OVER (PARTITION BY geo_location ORDER BY n DESC, day) AS by_count FROM dy")
    log("win02_gaps", "SELECT geo_location, bin, n, round((a - lag(b) OVER (PARTITION BY geo_location ORDER BY bin)) / 1e6, 6) AS gap_seconds FROM hb", ["hb AS (SELECT geo_location, epoch_us(ts) // 1800000000 AS bin, count(*) AS n, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM v GROUP BY 1, 2)"], "events")
    log("win03_dense_rank", "SELECT DISTINCT geo_location, filename, dense_rank() OVER (PARTITION BY geo_location ORDER BY filename) AS alpha_rank FROM log WHERE filename IS NOT NULL")
    log("win04_running_sum", "SELECT geo_location, epoch_us(day) AS day_us, dayofweek(day) AS wd, CAST(sum(n) OVER (PARTITION BY geo_location ORDER BY dayofweek(day)) AS BIGINT) AS running FROM dy")
    log("win05_share_of_total", "SELECT geo_location, accession, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY geo_location) AS DOUBLE), 6) AS share FROM vy GROUP BY 1, 2")
    series_cols = {"win06_rolling": WINDOW_COLS[6:10], "win07_pct_change": WINDOW_COLS[3:6]}
    for key, cols in series_cols.items():
        log(key, "SELECT geo_location, epoch_us(window_start) AS start_us, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols) + " FROM wf", [windows("month")])
    log("win08_last_n", "SELECT * FROM (SELECT geo_location, epoch_us(week) AS week_us, n, row_number() OVER (PARTITION BY geo_location ORDER BY week DESC) AS back FROM wk) WHERE back <= 12")
    log("win09_cumulative", "SELECT downloads, count(*) AS datasets, CAST(sum(count(*)) OVER (ORDER BY downloads) AS BIGINT) AS datasets_upto, CAST(sum(sum(downloads)) OVER (ORDER BY downloads) AS BIGINT) AS downloads_upto FROM dc GROUP BY 1", [DC.format(l="log")])
    log("win10_percent_rank", "SELECT accession, round((rank() OVER (ORDER BY downloads) + (count(*) OVER (PARTITION BY downloads) - 1) / 2.0) / count(*) OVER (), 6) AS pct_rank FROM dc", [DC.format(l="log")])
    log("win11_islands", "SELECT geo_location, len, count(*) AS runs FROM (SELECT geo_location, g, count(*) AS len FROM i WHERE n > m GROUP BY 1, 2) GROUP BY 1, 2", ["i AS (SELECT *, sum(CASE WHEN n > m THEN 0 ELSE 1 END) OVER (PARTITION BY geo_location ORDER BY day) AS g FROM (SELECT *, avg(n) OVER (PARTITION BY geo_location) AS m FROM dy))"])
    # ---- top-k and sets
    loc_cols = "geo_location, country, unique_users, total_downloads, round(downloads_per_user, 6) AS downloads_per_user"
    lab("top01_location_lists", " UNION ALL ".join(f"(SELECT {loc_cols}, '{n}' AS list FROM lab WHERE {w} ORDER BY lab.{b} DESC, geo_location LIMIT 10)" for n, w, b in (
        ("bots", "is_bot", "unique_users"), ("hubs", "is_hub", "downloads_per_user"), ("users", "final_label = 'user'", "total_downloads"))))
    lab("top02_class_tables", " UNION ALL ".join(f"(SELECT {loc_cols}, '{n}' AS list FROM lab WHERE is_{n} ORDER BY lab.total_downloads DESC, geo_location LIMIT 100)" for n in ("bot", "hub")))
    log("top03_datasets", top("log", 25))
    log("top04_dataset_years", "SELECT accession, year, count(*) AS downloads FROM log WHERE accession IN (SELECT accession FROM dc ORDER BY downloads DESC, accession LIMIT 25) GROUP BY 1, 2", [DC.format(l="log")])
    share = "SELECT country, 100.0 * count(CASE WHEN is_bot THEN 1 END) / count(*) AS v FROM lab GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 10"
    lab("top05_bot_share", f"SELECT country, round(CAST(v AS DOUBLE), 2) AS bot_pct FROM ({share})")
    cat_year = "SELECT year, CASE WHEN is_bot THEN 'bot' WHEN is_hub THEN 'hub' ELSE 'user' END AS category, count(*) AS total_downloads FROM log JOIN lab USING (geo_location) GROUP BY 1, 2"
    lab("set01_tagged_union", cat_year)
    lab("set02_distinct_keys", "SELECT DISTINCT geo_location FROM lab")
    # ---- scalar families
    log("scf01_date_time", """SELECT usr, filename, epoch_us(ts) AS us, year(ts) AS y, month(ts) AS mo, hour(ts) AS h, second(ts) AS s, millisecond(ts) AS ms, dayofweek(ts) AS wd,
      epoch_us(CAST(date_trunc('hour', ts) AS TIMESTAMP)) AS hour_us, epoch_us(CAST(date_trunc('week', ts) AS TIMESTAMP)) AS week_us, epoch_us(CAST(date_trunc('month', ts) AS TIMESTAMP)) AS month_us,
      epoch_us(ts - INTERVAL 30 DAY) AS before_us FROM raw""", source="events")
    log("scf02_strings", """SELECT DISTINCT filename, geo_location, lower(filename) AS low, substring(filename, 2, 3) AS part, regexp_extract(filename, '([0-9]+)', 1) AS digits, filename LIKE '%.raw' AS is_raw,
      ends_with(filename, '.gz') AS is_gz, CAST(split_part(geo_location, ',', 1) AS DOUBLE) AS lat, CAST(split_part(geo_location, ',', 2) AS DOUBLE) AS lon FROM log""")
    log("scf03_conversions", """SELECT filename, k, TRY_CAST(filename AS DOUBLE) AS none, coalesce(nullif(k % 5, 0), -1) AS m, greatest(k, 100) AS g, round(k / NULLIF(CAST(k % 3 AS DOUBLE), 0), 6) AS q
      FROM (SELECT DISTINCT filename, CAST(TRY_CAST(regexp_extract(filename, '([0-9]+)', 1) AS INTEGER) AS BIGINT) AS k FROM log)""")
    exprs = {"log2": "log2(x)", "ln": "ln(x)", "log1p": "ln(1 + x)", "e": "exp(-x / 1000)", "p": "power(x, 0.5)", "r": "sqrt(x)", "a": "abs(600 - x)", "rd": "round(x / 7, 2)",
             "c": "greatest(least(x / 1000, 0.7), 0.5)", "s": "sin(radians(x))", "as": "asin(1 / x)"}
    log("scf04_math", "SELECT geo_location, " + ", ".join(f'round({e}, 6) + 0.0 AS "{k}"' for k, e in exprs.items()) + " FROM (SELECT geo_location, CAST(total_downloads AS DOUBLE) AS x FROM base)", [BASE])
    log("scf05_arrays", """SELECT geo_location, array_to_string(list_concat(list_resize(CAST([] AS BIGINT[]), 6 - len(l), 0), l), ',') AS padded, CAST(list_sum(l) AS BIGINT) AS s FROM (
      SELECT geo_location, list(n ORDER BY b DESC) AS l FROM (SELECT *, row_number() OVER (PARTITION BY geo_location ORDER BY week DESC) AS b FROM wk) WHERE b <= 4 GROUP BY 1)""")
    o["scf06_json"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS t FROM events"
    log("scf07_geo", """SELECT geo_location, lat, lon, round(2 * 6371 * asin(sqrt(power(sin(radians(-lat) / 2), 2) + cos(radians(lat)) * power(sin(radians(-lon) / 2), 2))), 6) AS km_to_origin
      FROM (SELECT DISTINCT geo_location, CAST(split_part(geo_location, ',', 1) AS DOUBLE) AS lat, CAST(split_part(geo_location, ',', 2) AS DOUBLE) AS lon FROM vy)""")
    kind = file_type("filename")
    log("scf08_categories", f"SELECT country, {WORLD} AS world_region, {REUSE} AS reuse_region, kind, {lookup('kind', cat.REUSE_CLASSES, 'archives_other')} AS reuse, count(*) AS n FROM (SELECT *, {kind} AS kind FROM nm) GROUP BY ALL", NAMED)
    # ---- analytics
    by_country = "SELECT country, count(*) AS total_downloads, count(DISTINCT accession) AS unique_datasets, count(DISTINCT geo_location) AS unique_locations, min(year) AS first_year, max(year) AS last_year FROM {l} WHERE country IS NOT NULL AND country <> '' AND country NOT LIKE '%{{%' GROUP BY 1"
    log("anl01_by_country", by_country.format(l="ul"), USERS)
    log("anl02_by_world_region", f"SELECT {WORLD} AS world_region, CAST(sum(total_downloads) AS BIGINT) AS total_downloads, CAST(sum(unique_datasets) AS BIGINT) AS unique_datasets, CAST(sum(unique_locations) AS BIGINT) AS unique_locations, count(*) AS num_countries FROM bc GROUP BY 1",
        NAMED + [f"bc AS ({by_country.format(l='nm')})"])
    log("anl03_yearly", "SELECT year, count(*) AS total_downloads, count(DISTINCT accession) AS unique_datasets, count(DISTINCT geo_location) AS unique_locations FROM ul WHERE year BETWEEN 1996 AND 2000 GROUP BY 1", USERS)
    log("anl04_monthly", "SELECT year, month(ts) AS month, count(*) AS total_downloads FROM ul WHERE year BETWEEN 1996 AND 2000 GROUP BY 1, 2", USERS)
    lab("anl05_yearly_by_category", cat_year)
    lab("anl06_growth", "SELECT year, round((n - p) * 100.0 / p, 6) + 0.0 AS growth_pct FROM (SELECT year, total_downloads AS n, lag(total_downloads) OVER (ORDER BY year) AS p FROM cy WHERE category = 'user')", [f"cy AS ({cat_year})"])
    log("anl07_protocol_by_year", "SELECT method AS protocol, year, count(*) AS downloads FROM nl WHERE year >= 1996 GROUP BY 1, 2", NOBOTS)
    log("anl07_protocol_by_month", "SELECT method AS protocol, month(ts) AS month, count(*) AS downloads FROM nl WHERE year = 2000 GROUP BY 1, 2", NOBOTS)
    log("anl07_protocol_overall", "SELECT method AS protocol, count(*) AS downloads, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM ul WHERE year >= 1996 GROUP BY 1", USERS)
    log("anl08_top_datasets", top("ul", 100), USERS)
    log("anl09_top_datasets_hub", top("hl", 100), HUBS)
    dcu = USERS + [DC.format(l="ul")]
    log("anl10_gini", "SELECT round(2.0 * sum(CAST(i * downloads AS DOUBLE)) / (count(*) * CAST(sum(downloads) AS DOUBLE)) - (count(*) + 1.0) / count(*), 6) AS gini_coefficient FROM (SELECT *, row_number() OVER (ORDER BY downloads) AS i FROM dc)", dcu)
    log("anl11_lorenz", """SELECT round(x, 6) + 0.0 AS population_fraction, round(coalesce(a.c, 0) + (coalesce(b.c, a.c) - coalesce(a.c, 0)) * (x * n - floor(x * n + 1e-9)), 6) + 0.0 AS download_fraction FROM gx
      LEFT JOIN cum a ON a.i = CAST(floor(x * n + 1e-9) AS BIGINT) LEFT JOIN cum b ON b.i = CAST(floor(x * n + 1e-9) AS BIGINT) + 1""", dcu + [
        "cum AS (SELECT row_number() OVER (ORDER BY downloads, accession) AS i, CAST(sum(downloads) OVER (ORDER BY downloads, accession) AS DOUBLE) / (SELECT sum(downloads) FROM dc) AS c FROM dc)",
        "gx AS (SELECT k / 100.0 AS x, (SELECT count(*) FROM dc) AS n FROM (SELECT unnest(range(101)) AS k))"])
    pct = lambda k: f"round(100.0 * sum(CASE WHEN r <= {k} THEN downloads ELSE 0 END) / sum(downloads), 6)"
    log("anl12_concentration", f"""SELECT count(*) AS total_datasets, CAST(sum(downloads) AS BIGINT) AS total_downloads, {pct('greatest(n // 100, 1)')} AS top_1pct_downloads_pct, {pct('greatest(n // 10, 1)')} AS top_10pct_downloads_pct,
      {pct('n // 2')} AS top_50pct_downloads_pct, CAST(floor(median(downloads)) AS BIGINT) AS median_downloads, round(avg(downloads), 6) AS mean_downloads, max(downloads) AS max_downloads
      FROM (SELECT *, row_number() OVER (ORDER BY downloads DESC, accession) AS r, count(*) OVER () AS n FROM dc)""", dcu)
    log("anl13_rank_frequency", "SELECT accession, downloads, row_number() OVER (ORDER BY downloads DESC, accession) AS rank FROM dc", dcu)
    log("anl14_heatmap", "SELECT hour(ts) AS hour, dayofweek(ts) AS day_of_week, count(*) AS downloads, round(count(*) / CAST(max(count(*)) OVER () AS DOUBLE), 6) AS norm FROM ul WHERE year >= 1996 GROUP BY 1, 2", USERS)
    bubble = "SELECT country, count(*) AS total_downloads, count(DISTINCT usr) AS unique_users, round(CAST(count(*) AS DOUBLE) / count(DISTINCT usr), 6) AS dl_per_user FROM {l} GROUP BY 1 HAVING count(*) >= 100"
    log("anl15_country_bubble", bubble.format(l="ul"), USERS)
    log("flagship_clean_country_downloads", bubble.format(l="ul"), FLAGSHIP_LABELS + [USERS[-1]])
    log("anl15_country_bubble_hub", bubble.format(l="hl"), HUBS)
    log("anl15_country_bubble_top", "SELECT country, count(*) AS total_downloads, count(DISTINCT usr) AS unique_users, count(DISTINCT accession) AS unique_datasets, round(CAST(count(*) AS DOUBLE) / count(DISTINCT usr), 6) AS dl_per_user FROM ul GROUP BY 1 HAVING count(*) > 500 ORDER BY 2 DESC, 1 LIMIT 50", USERS)
    ft = f"ft AS (SELECT {REUSE} AS reuse_region, {kind} AS file_category, count(*) AS downloads FROM nm WHERE filename IS NOT NULL GROUP BY 1, 2)"
    log("anl16_filetype_by_region", "SELECT * FROM ft", NAMED + [ft])
    log("anl17_reuse_share", f"SELECT reuse_region, {lookup('file_category', cat.REUSE_CLASSES, 'archives_other')} AS agg_type, CAST(sum(downloads) AS BIGINT) AS downloads, round(100.0 * sum(downloads) / sum(sum(downloads)) OVER (PARTITION BY reuse_region), 6) AS pct FROM ft GROUP BY 1, 2", NAMED + [ft])
    log("anl18_dataset_overview", "SELECT count(*) AS total_records, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(DISTINCT country) AS n_countries, count(DISTINCT geo_location) AS n_unique_locations, count(DISTINCT accession) AS n_projects FROM log")
    log("anl18_protocol_histogram", "SELECT method, count(*) AS downloads FROM log GROUP BY 1")
    log("anl19_platform_overview", """SELECT total_downloads, unique_projects, unique_files, unique_users, min_year, max_year, round(total_downloads / CAST(unique_projects AS DOUBLE), 6) AS dl_per_project,
      round(total_downloads / CAST(unique_files AS DOUBLE), 6) AS dl_per_file, round(total_downloads / CAST(unique_users AS DOUBLE), 6) AS dl_per_user,
      (SELECT count(*) FROM (SELECT country FROM log GROUP BY 1 HAVING count(*) > 100)) AS n_countries, round(100.0 * unique_projects / (SELECT count(DISTINCT p_partkey) FROM part), 6) AS project_coverage,
      round(100.0 * unique_files / (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem)), 6) AS file_coverage
      FROM (SELECT count(*) AS total_downloads, count(DISTINCT accession) AS unique_projects, count(DISTINCT filename) AS unique_files, count(DISTINCT usr) AS unique_users, min(year) AS min_year, max(year) AS max_year FROM log)""")
    log("anl20_consistency", """SELECT accession, round(c, 6) AS consistency, total FROM (SELECT accession, round((1 - least(stddev_pop(n) / avg(n), 1)) * count(*) / 7.0, 9) AS c, CAST(sum(n) AS BIGINT) AS total FROM (
      SELECT accession, year, count(*) AS n FROM ul GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20)""", USERS)
    yrs = range(FIRST, LAST + 1)
    log("anl21_consistency_heatmap", "SELECT accession, " + ", ".join(f"round(log10(count(CASE WHEN year = {y} THEN 1 END) + 1), 6) AS y{y}" for y in yrs) + ", count(DISTINCT year) AS active_years FROM ul WHERE accession IN (SELECT accession FROM dc ORDER BY downloads DESC, accession LIMIT 25) GROUP BY 1", dcu)
    log("anl22_downloads_per_file", "SELECT bin, count(*) AS files FROM (SELECT CAST(least(floor(log10(n) / log10((SELECT max(n) FROM fc)) * 99 + 1e-9), 98) AS BIGINT) AS bin FROM fc) GROUP BY 1", USERS + ["fc AS (SELECT filename, count(*) AS n FROM ul WHERE filename IS NOT NULL GROUP BY 1)"])
    log("anl23_country_trend", "SELECT country, year, count(*) AS downloads, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY year), 6) AS pct FROM ul WHERE year >= 1996 AND country IN ('NATION_1', 'NATION_3', 'NATION_5', 'NATION_8') GROUP BY 1, 2", USERS)
    log("anl24_before_after", "SELECT coalesce(a.country, b.country) AS country, CAST(raw_downloads AS DOUBLE) AS raw_downloads, CAST(clean_downloads AS DOUBLE) AS clean_downloads FROM (SELECT country, count(*) AS raw_downloads FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) a FULL JOIN (SELECT country, count(*) AS clean_downloads FROM ul GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) b ON a.country = b.country", USERS)
    lab("anl25_hub_points", "SELECT geo_location, CAST(split_part(geo_location, ',', 1) AS DOUBLE) AS lat, CAST(split_part(geo_location, ',', 2) AS DOUBLE) AS lon, total_downloads FROM lab WHERE is_hub")
    lab("anl25_hub_countries", "SELECT country, count(*) AS hubs, CAST(sum(total_downloads) AS BIGINT) AS downloads FROM lab WHERE is_hub GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
    lab("anl26_classes_by_country", "SELECT country, count(*) AS locations, CAST(sum(total_downloads) AS BIGINT) AS total_downloads, " + ", ".join(f"count(CASE WHEN final_label = '{c}' THEN 1 END) AS {c}_locations, CAST(sum(CASE WHEN final_label = '{c}' THEN total_downloads ELSE 0 END) AS BIGINT) AS {c}_downloads" for c in KINDS) + " FROM lab GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5")
    log("anl27_citations", """SELECT (SELECT count(*) FROM ct) AS n_cited, (SELECT round(corr(rc, rd), 6) FROM ct) AS spearman, (SELECT round(regr_slope(log10(total_downloads), log10(c)), 6) FROM ct) AS log_slope,
      round((SELECT (12 / (max(n) * (max(n) + 1.0)) * sum(s * s / k) - 3 * (max(n) + 1)) FROM gr) / (1 - (SELECT sum(power(t, 3) - t) FROM (SELECT count(*) AS t FROM us GROUP BY cons)) / (SELECT power(max(n), 3) - max(n) FROM gr)), 6) AS kruskal_h""",
      ["""ba AS (SELECT accession, total_downloads, greatest(p - 1, 0) AS c, least(ya, 5) AS cons FROM (SELECT accession, count(*) AS total_downloads, max(year) - min(year) + 1 - count(DISTINCT country) % 4 AS ya FROM log GROUP BY 1)
        JOIN (SELECT concat('PXD', lpad(CAST(p_partkey AS VARCHAR), 6, '0')) AS accession, (p_size % 8) * (p_size % 8) AS p FROM part) USING (accession))""",
       "ct AS (SELECT *, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rc, rank() OVER (ORDER BY total_downloads) + (count(*) OVER (PARTITION BY total_downloads) - 1) / 2.0 AS rd FROM ba WHERE c > 0)",
       "bn AS (SELECT *, CASE WHEN c < 1 THEN 0 WHEN c < 5 THEN 1 WHEN c < 20 THEN 2 WHEN c < 50 THEN 3 ELSE 4 END AS bin FROM ba)",
       "us AS (SELECT *, rank() OVER (ORDER BY cons) + (count(*) OVER (PARTITION BY cons) - 1) / 2.0 AS rk FROM bn WHERE bin IN (SELECT bin FROM bn GROUP BY 1 HAVING count(*) > 1))",
       "gr AS (SELECT bin, sum(rk) AS s, CAST(count(*) AS DOUBLE) AS k, CAST(sum(count(*)) OVER () AS DOUBLE) AS n FROM us GROUP BY 1)"])
    # ---- reports
    lab("rpt01_run_totals", f"SELECT CAST(sum(total_downloads) AS BIGINT) AS total, {DOWNLOADS.format(c='is_bot')} AS bots, {DOWNLOADS.format(c='is_hub')} AS hubs, {DOWNLOADS.format(c='NOT is_bot AND NOT is_hub')} AS normal FROM lab")
    lab("rpt02_classification_counts", "SELECT final_label, count(*) AS locations, CAST(sum(total_downloads) AS BIGINT) AS downloads, round(count(*) * 100e0 / sum(count(*)) OVER (), 2) AS locations_pct, round(sum(total_downloads) * 100e0 / sum(sum(total_downloads)) OVER (), 2) AS downloads_pct FROM lab GROUP BY 1")
    lab("rpt03_hierarchy_counts", """SELECT 'behavior_type' AS level, behavior_type AS value, count(*) AS locations, CAST(sum(total_downloads) AS BIGINT) AS downloads, round(count(*) * 100e0 / (SELECT count(*) FROM lab), 2) AS pct, round(count(*) * 100e0 / (SELECT count(*) FROM lab), 2) AS pct_of_total FROM lab GROUP BY 2
      UNION ALL SELECT 'automation_category', automation_category, count(*), CAST(sum(total_downloads) AS BIGINT), round(count(*) * 100e0 / (SELECT count(*) FROM lab WHERE behavior_type = 'automated'), 2), round(count(*) * 100e0 / (SELECT count(*) FROM lab), 2)
      FROM lab WHERE behavior_type = 'automated' AND automation_category IS NOT NULL GROUP BY 2""")
    prof = [YEARLY, BURST, "lp AS (SELECT lab.*, y.* EXCLUDE (geo_location), coalesce(burst_pattern_score, 0) AS burst_pattern_score FROM lab JOIN yearly y USING (geo_location) LEFT JOIN burst USING (geo_location))"]
    have = {"unique_users", "downloads_per_user", "total_downloads", "working_hours_ratio", "night_activity_ratio", "hourly_entropy", "burst_pattern_score", "fraction_latest_year", "spike_ratio"}

    def long(features):
        return "lf AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v, is_bot FROM lp" for f in features if f in have) + ")"
    lab("rpt04_feature_profile", out("feature count:i mean:r std:r min:r max:r bot_mean:r bot_std:r normal_mean:r normal_std:r q25:r median:r q75:r q95:r", "pf"), prof + [long(PROFILED), """pf AS (SELECT feature, count(*) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max,
      avg(CASE WHEN is_bot THEN v END) AS bot_mean, stddev_samp(CASE WHEN is_bot THEN v END) AS bot_std, avg(CASE WHEN NOT is_bot THEN v END) AS normal_mean, stddev_samp(CASE WHEN NOT is_bot THEN v END) AS normal_std,
      quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.95) AS q95 FROM lf GROUP BY 1)"""])
    lab("rpt05_temporal_metrics", out("years_span_mean:r years_span_max:i single_year_locations multi_year_locations latest_fraction_mean:r high_concentration very_high_concentration new_locations:i new_locations_pct:r working_hours_mean:r daytime_dominant nighttime_dominant years_span_median:r latest_fraction_median:r working_hours_median:r", "tm"),
        prof + ["""tm AS (SELECT avg(years_span) AS years_span_mean, max(years_span) AS years_span_max, count(CASE WHEN years_span = 1 THEN 1 END) AS single_year_locations, count(CASE WHEN years_span > 1 THEN 1 END) AS multi_year_locations,
        avg(fraction_latest_year) AS latest_fraction_mean, count(CASE WHEN fraction_latest_year > 0.8 THEN 1 END) AS high_concentration, count(CASE WHEN fraction_latest_year > 0.95 THEN 1 END) AS very_high_concentration,
        sum(is_new_location) AS new_locations, avg(is_new_location) * 100 AS new_locations_pct, avg(working_hours_ratio) AS working_hours_mean, count(CASE WHEN working_hours_ratio > 0.6 THEN 1 END) AS daytime_dominant,
        count(CASE WHEN working_hours_ratio < 0.3 THEN 1 END) AS nighttime_dominant, median(years_span) AS years_span_median, median(fraction_latest_year) AS latest_fraction_median, median(working_hours_ratio) AS working_hours_median FROM lp)"""])
    geo = ("gm AS (SELECT country, CAST(count(*) AS DOUBLE) AS locations, CAST(sum(total_downloads) AS DOUBLE) AS downloads, CAST(count(CASE WHEN is_bot THEN 1 END) AS DOUBLE) AS bots, "
           "100e0 * count(CASE WHEN is_bot THEN 1 END) / count(*) AS bot_pct FROM lab GROUP BY 1)")
    lab("rpt06_geographic_metrics", " UNION ALL ".join(f"(SELECT '{m}' AS metric, country, round({m}, 6) AS value FROM gm WHERE {w} ORDER BY gm.{m} DESC, country LIMIT 10)" for m, w in (("locations", "true"), ("downloads", "true"), ("bots", "bots > 0"), ("bot_pct", "locations >= 3"))), [geo])
    lab("rpt07_download_metrics", out("total_downloads:i dpu_mean:r dpu_max:r dpu_very_high dpu_very_low users_total:i users_mean:r users_max single_user_locations high_user_locations dpu_median:r users_median:r", "dm"), ["""dm AS (SELECT sum(total_downloads) AS total_downloads,
      avg(downloads_per_user) AS dpu_mean, max(downloads_per_user) AS dpu_max, count(CASE WHEN downloads_per_user > 500 THEN 1 END) AS dpu_very_high, count(CASE WHEN downloads_per_user < 10 THEN 1 END) AS dpu_very_low,
      sum(unique_users) AS users_total, avg(unique_users) AS users_mean, max(unique_users) AS users_max, count(CASE WHEN unique_users = 1 THEN 1 END) AS single_user_locations, count(CASE WHEN unique_users > 1000 THEN 1 END) AS high_user_locations,
      median(downloads_per_user) AS dpu_median, median(unique_users) AS users_median FROM lab)"""])
    lab("rpt08_bot_correlation", "SELECT feature, round(corr(v, CAST(is_bot AS DOUBLE)), 4) + 0.0 AS corr FROM lf GROUP BY 1 HAVING count(*) >= 10 AND var_pop(v) > 0", prof + [long(IMPORTANCE)])
    lab("rpt09_correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CASE WHEN var_pop({a}) > 0 AND var_pop({b}) > 0 THEN round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) + 0.0 END AS corr FROM lab" for a in KEY for b in KEY))
    lab("rpt10_city_rollup", """SELECT country, city, CAST(sum(unique_users) AS BIGINT) AS total_users, CAST(sum(total_downloads) AS BIGINT) AS total_downloads, count(*) AS num_locations, round(sum(total_downloads) / CAST(sum(unique_users) AS DOUBLE), 6) AS downloads_per_user
      FROM lab GROUP BY 1, 2 HAVING sum(total_downloads) > 600 ORDER BY sum(total_downloads) / CAST(sum(unique_users) AS DOUBLE) DESC, 1, 2 LIMIT 50""")
    listing = "SELECT country, city, geo_location, unique_users, round(downloads_per_user, 6) AS downloads_per_user, '{c}' AS list FROM lab WHERE final_label = '{c}'"
    lab("rpt12_listings", " UNION ALL ".join(listing.format(c=c) for c in ("bot", "hub")))
    lab("rpt13_histogram", """SELECT final_label, CAST(least(floor((v - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS locations FROM (SELECT final_label, downloads_per_user AS v, min(downloads_per_user) OVER (PARTITION BY final_label) AS lo,
      max(downloads_per_user) OVER (PARTITION BY final_label) AS hi FROM lab) GROUP BY 1, 2""")
    lab("rpt13_quartiles", "SELECT final_label, round(quantile_cont(downloads_per_user, 0.25), 6) AS q1, round(quantile_cont(downloads_per_user, 0.5), 6) AS median, round(quantile_cont(downloads_per_user, 0.75), 6) AS q3 FROM lab GROUP BY 1")
    lab("rpt14_class_countries", "SELECT * FROM (SELECT final_label, country, CAST(sum(total_downloads) AS BIGINT) AS downloads, row_number() OVER (PARTITION BY final_label ORDER BY sum(total_downloads) DESC, country) AS rank FROM lab GROUP BY 1, 2) WHERE rank <= 30")
    lab("rpt15_prediction_summary", "SELECT final_label, count(*) AS locations, round(avg(classification_confidence), 6) AS mean_confidence, round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS pct, round((SELECT avg(CASE WHEN classification_confidence < 0.5 THEN 100e0 ELSE 0 END) FROM lab), 6) AS low_confidence_pct FROM lab GROUP BY 1")
    return o
