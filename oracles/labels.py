"""DuckDB SQL for sources, filters, joins, classification, evaluation and annotation."""

from __future__ import annotations

from logtide.catalogue_labels import FLAGSHIP, LIGHT, PATTERN, RICH, SEEDS, TRUTH
from logtide.operators.learned import MODEL_FEATURES
from oracles.base import out, query
from oracles.features import (AUTHENTIC, BASE, BURST, COORD, DOW, FILE_DIV, PROJECT, PROTOCOL,
                              REGULARITY, SESSION_COUNT, TIME_OF_DAY, WHOLE_REGULARITY, YEARLY)

RICH_TABLE = [BASE, TIME_OF_DAY, PROJECT, PROTOCOL, YEARLY, BURST, COORD, REGULARITY,
              AUTHENTIC.format(farm=100, hom=2.0), """t AS (
  SELECT b.*, d.* EXCLUDE (geo_location),
    p.* EXCLUDE (geo_location), pr.* EXCLUDE (geo_location), y.* EXCLUDE (geo_location),
    coalesce(burst_pattern_score, 0) AS burst_pattern_score, coalesce(user_coordination_score, 0) AS user_coordination_score,
    coalesce(regularity_score, 0) AS regularity_score, coalesce(interval_cv, 1) AS interval_cv,
    coalesce(user_authenticity_score, 1) AS user_authenticity_score
  FROM base b JOIN time_of_day d USING (geo_location) JOIN project p USING (geo_location) JOIN protocol pr USING (geo_location)
  JOIN yearly y USING (geo_location) LEFT JOIN burst bu USING (geo_location) LEFT JOIN coord c USING (geo_location)
  LEFT JOIN regularity r USING (geo_location) LEFT JOIN authentic a USING (geo_location))"""]
WHOLE_TABLE = [WHOLE_REGULARITY if cte == REGULARITY else cte for cte in RICH_TABLE]
RICH_COLUMNS = {
    "unique_users", "downloads_per_user", "total_downloads", "unique_projects", "years_active",
    "working_hours_ratio", "night_activity_ratio", "hourly_entropy", "regularity_score",
    "interval_cv", "user_coordination_score", "user_authenticity_score"}
LIGHT_TABLE = [BASE, TIME_OF_DAY, """t AS (
  SELECT b.*, d.* EXCLUDE (geo_location) FROM base b JOIN time_of_day d USING (geo_location))"""]


def pattern_sql(pattern: dict, columns=RICH_COLUMNS) -> str:
    conds = []
    for name, spec in pattern.items():
        if name in ("id", "description", "parent"):
            continue
        if name not in columns:
            return "false"
        if not isinstance(spec, dict):
            conds.append(f"{name} = {spec}")
            continue
        for key, op in (("min", ">="), ("max", "<=")):
            if key in spec:
                conds.append(f"{name} {op} {spec[key]}")
    return "coalesce(" + " AND ".join(conds) + ", false)"


def any_sql(patterns: list) -> str:
    return "(" + (" OR ".join(pattern_sql(p) for p in patterns) or "false") + ")"


def rule_ctes(r, hub_features: bool) -> list[str]:
    b, c = r.taxonomy["behavior_type"], r.taxonomy["automation_category"]
    protocol = (f"(aspera_ratio > {r.hub_aspera} OR globus_ratio > {r.hub_globus})"
                if hub_features else "false")
    single = f"top_project_concentration > {r.exclude_top_project}" if hub_features else "false"
    demote = (f"behavior_type = 'hub' AND project_hhi > {r.demote_hhi} AND (top3_project_concentration > {r.demote_top3} "
              f"OR (total_downloads > {r.demote_volume} AND top3_project_concentration > {r.demote_volume_top3}))"
              if hub_features else "false")
    return [
        f"""bt AS (SELECT *, CASE WHEN {any_sql(b['automated'])} THEN 'automated' WHEN {any_sql(b['organic'])} THEN 'organic'
          WHEN unique_users <= {r.organic_max_users} THEN 'organic' ELSE 'automated' END AS behavior_type FROM t)""",
        f"""ac AS (SELECT *, CASE WHEN behavior_type = 'automated' THEN
          CASE WHEN {any_sql(c['legitimate_automation'])} THEN 'legitimate_automation' WHEN {any_sql(c['bot'])} THEN 'bot'
            WHEN downloads_per_user >= {r.hub_min_dl_per_user} THEN 'legitimate_automation'
            WHEN unique_users > {r.bot_min_users} AND downloads_per_user < {r.bot_max_dl_per_user} THEN 'bot' ELSE 'bot' END END AS automation_category FROM bt)""",
        f"""hp AS (SELECT * REPLACE (CASE WHEN hub THEN 'hub' ELSE behavior_type END AS behavior_type,
            CASE WHEN hub THEN 'legitimate_automation' ELSE automation_category END AS automation_category), hub AS is_protected_hub
          FROM (SELECT *, ({protocol} OR (downloads_per_user > {r.hub_dl_per_user} AND unique_users <= {r.hub_max_users}))
            AND NOT (working_hours_ratio < {r.exclude_max_working} AND night_activity_ratio > {r.exclude_min_night})
            AND NOT ({single}) AS hub FROM ac))""",
        f"""hd AS (SELECT * REPLACE (CASE WHEN dem THEN 'bot' ELSE behavior_type END AS behavior_type,
            CASE WHEN dem THEN 'bot' ELSE automation_category END AS automation_category, is_protected_hub AND NOT dem AS is_protected_hub)
          FROM (SELECT *, {demote} AS dem FROM hp))""",
        """lab AS (SELECT *, coalesce(automation_category = 'bot', false) AS is_bot, coalesce(automation_category = 'legitimate_automation', false) AS is_hub,
          behavior_type = 'organic' AS is_organic, """ + CONFIDENCE + """ AS classification_confidence,
          CASE WHEN coalesce(automation_category = 'bot', false) THEN 'bot' WHEN coalesce(automation_category = 'legitimate_automation', false) THEN 'hub' ELSE 'user' END AS final_label FROM hd)""",
    ]


CONFIDENCE = """CASE WHEN behavior_type = 'organic' THEN 0.3e0 + 0.7e0 * (greatest(least(1 - log10(unique_users + 1) / 4, 1), 0) + greatest(least(working_hours_ratio, 1), 0)) / 2
  WHEN automation_category = 'legitimate_automation' THEN 0.4e0 + 0.6e0 * greatest(least(log10(downloads_per_user + 1) / 4, 1), 0)
  WHEN automation_category = 'bot' THEN 0.4e0 + 0.3e0 * greatest(least(log10(unique_users + 1) / 5, 1), 0) + 0.3e0 * greatest(least(1 - downloads_per_user / 200, 1), 0)
  ELSE 0.5 END"""

LIGHT_LABELS = LIGHT_TABLE + rule_ctes(LIGHT, False)
FLAGSHIP_LABELS = LIGHT_TABLE + rule_ctes(FLAGSHIP, False)
RICH_LABELS = RICH_TABLE + rule_ctes(RICH, True)
WHOLE_LABELS = WHOLE_TABLE + rule_ctes(RICH, True)


def seed_ctes(r=SEEDS) -> list[str]:
    a = (f"unique_users <= {r.a_users} AND downloads_per_user <= {r.a_dpu} AND total_downloads BETWEEN {r.min_downloads} AND {r.a_downloads} "
         f"AND working_hours_ratio > {r.a_working} AND night_activity_ratio < {r.a_night} AND years_span >= {r.a_years}")
    b = (f"unique_users <= {r.b_users} AND downloads_per_user <= {r.b_dpu} AND total_downloads BETWEEN {r.min_downloads} AND {r.b_downloads} "
         f"AND working_hours_ratio > {r.b_working} AND hourly_entropy > {r.b_entropy} AND burst_pattern_score < {r.b_burst}")
    c = (f"unique_users <= {r.c_users} AND downloads_per_user <= {r.c_dpu} AND total_downloads >= {r.min_downloads} "
         f"AND user_coordination_score < {r.c_coordination} AND protocol_legitimacy_score > {r.c_protocol} "
         f"AND NOT (fraction_latest_year > {r.c_latest} AND unique_users > {r.c_latest_users}) AND NOT (years_span < {r.c_years} AND unique_users > {r.c_years_users})")
    return [
        f"oseed AS (SELECT geo_location, CASE WHEN {a} THEN 1.0 WHEN {b} THEN 0.7 WHEN {c} THEN 0.4 END AS seed_confidence FROM t WHERE ({a}) OR ({b}) OR ({c}))",
        f"""bsig AS (SELECT *, unique_users > {r.farm_users} AND downloads_per_user < {r.farm_dpu} AS farm,
          unique_users > {r.spread_users} AND downloads_per_user < {r.spread_dpu} AND downloads_per_user > {r.spread_min_dpu}
            AND working_hours_ratio < {r.spread_working} AND fraction_latest_year > {r.spread_latest} AS spread,
          night_activity_ratio > {r.night_share} AND working_hours_ratio < {r.night_working} AND total_downloads >= {r.min_downloads} AS noct,
          unique_users > {r.massive_users} AND downloads_per_user < {r.massive_dpu} AS massive, unique_projects > {r.scraper_projects} AS scraper,
          spike_ratio > {r.growth_spike} AND unique_users > {r.growth_users} AND fraction_latest_year > {r.growth_latest} AS growth,
          downloads_per_user > {r.hub_like_dpu} AND years_span >= {r.hub_like_years} AS hublike FROM t)""",
        f"""bseed AS (SELECT geo_location, CASE WHEN spread AND NOT farm AND NOT noct AND NOT massive AND NOT scraper THEN 0.6
          WHEN farm AND noct THEN 0.95 WHEN unique_users > {r.massive_users} THEN 0.9 ELSE 0.7 END AS seed_confidence
          FROM bsig WHERE (farm OR spread OR noct OR massive OR scraper OR growth) AND total_downloads >= {r.min_downloads} AND NOT hublike)""",
        f"""hseed AS (SELECT geo_location, CASE WHEN aspera_ratio > {r.hub_aspera} OR globus_ratio > {r.hub_globus} THEN 0.95
          WHEN years_span >= {r.long_years} THEN 0.85 ELSE 0.8 END AS seed_confidence FROM t
          WHERE ((downloads_per_user > {r.mirror_dpu} AND unique_users < {r.mirror_users}) OR (downloads_per_user > {r.institution_dpu}
            AND unique_users <= {r.institution_users} AND years_span >= {r.institution_years}))
          AND NOT (working_hours_ratio < {r.hub_working} AND night_activity_ratio > {r.hub_night}) AND total_downloads >= {r.min_downloads})""",
        """bseed2 AS (SELECT * FROM bseed WHERE geo_location NOT IN (SELECT geo_location FROM hseed))""",
        """seeds AS (SELECT geo_location, 'organic' AS label, seed_confidence FROM oseed WHERE geo_location NOT IN (SELECT geo_location FROM bseed2)
          UNION ALL SELECT geo_location, 'bot', seed_confidence FROM bseed2 UNION ALL SELECT geo_location, 'hub', seed_confidence FROM hseed)""",
        """corr AS (SELECT geo_location, CASE WHEN substr(md5(geo_location), 2, 1) < '4' THEN 'bot' WHEN substr(md5(geo_location), 2, 1) < '8' THEN 'hub'
            WHEN substr(md5(geo_location), 2, 1) < 'd' THEN 'organic' ELSE 'other' END AS label, 1 AS position FROM t WHERE substr(md5(geo_location), 1, 1) < '5'
          UNION ALL SELECT geo_location, 'organic', 2 FROM t WHERE substr(md5(geo_location), 1, 1) < '2'),
        lastc AS (SELECT geo_location, label FROM (SELECT *, row_number() OVER (PARTITION BY geo_location ORDER BY position DESC) AS r
          FROM corr WHERE label IN ('bot', 'hub', 'organic')) WHERE r = 1),
        injected AS (SELECT * FROM seeds WHERE geo_location NOT IN (SELECT geo_location FROM lastc)
          UNION ALL SELECT geo_location, label, 0.95 FROM lastc)""",
    ]


GOLD = """gold AS (SELECT geo_location, CASE WHEN substr(md5(geo_location), 1, 1) < '6' THEN 'bot' WHEN substr(md5(geo_location), 1, 1) < 'a' THEN 'hub' ELSE 'organic' END AS label,
  CASE WHEN substr(md5(geo_location), 2, 1) < 'b' THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT geo_location FROM log))"""

ANNOTATORS = """ann AS (SELECT CAST(doc_id AS VARCHAR) AS geo_location, doc_id,
  CASE WHEN doc_id % 17 = 0 THEN NULL WHEN quality = 1 THEN 'organic' WHEN doc_id % 3 = 0 THEN 'hub' ELSE 'bot' END AS a,
  CASE WHEN doc_id % 19 = 0 THEN NULL WHEN toxic = 1 THEN 'bot' WHEN doc_id % 5 = 0 THEN 'hub' WHEN doc_id % 2 = 0 THEN 'organic' ELSE 'bot' END AS b,
  CASE WHEN doc_id % 7 < 3 THEN 'user' WHEN doc_id % 7 = 3 THEN 'hub' ELSE 'bot' END AS truth FROM labels)"""
PAIRS = """pairs AS (SELECT geo_location, truth, coalesce(replace(a, 'organic', 'user'), 'user') AS pred FROM ann)"""
CLASSES = "cls AS (SELECT unnest(['bot', 'hub', 'user']) AS class)"


def metrics(pairs: str, name: str, key: str = "") -> str:
    k, by = (f"{key}, ", f"{key}, class") if key else ("", "class")
    return f"""{name}_c AS (SELECT {k}class, count(CASE WHEN pred = class AND truth = class THEN 1 END) AS tp, count(CASE WHEN pred = class AND truth <> class THEN 1 END) AS fp,
  count(CASE WHEN pred <> class AND truth = class THEN 1 END) AS fn, count(CASE WHEN pred <> class AND truth <> class THEN 1 END) AS tn, count(*) AS total
  FROM {pairs}, cls GROUP BY {by}),
{name} AS (SELECT *, coalesce(2 * precision * recall / NULLIF(precision + recall, 0), 0) AS f1 FROM (
  SELECT *, coalesce(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS recall,
    CAST(tp + tn AS DOUBLE) / total AS accuracy FROM {name}_c))"""


VOTES = """votes AS (
  SELECT geo_location, 'a' AS method, coalesce(replace(a, 'organic', 'user'), 'user') AS label, ((doc_id * 31) % 100) / 100.0 AS confidence, doc_id % 1000 + 1 AS total_downloads FROM ann
  UNION ALL SELECT geo_location, 'b', coalesce(replace(b, 'organic', 'user'), 'user'), ((doc_id * 32) % 100) / 100.0, doc_id % 1000 + 1 FROM ann
  UNION ALL SELECT geo_location, 'c', truth, ((doc_id * 33) % 100) / 100.0, doc_id % 1000 + 1 FROM ann)"""

DISCOVERY = """vc AS (SELECT geo_location, label, count(DISTINCT method) AS k, min(method) AS m FROM votes WHERE label IN ('bot', 'hub') GROUP BY 1, 2),
disc AS (SELECT f.label, f.method, f.found, (SELECT count(*) FROM vc WHERE vc.label = f.label AND k = 1 AND m = f.method) AS unique_to_method,
  (SELECT count(*) FROM vc WHERE vc.label = f.label AND k = 3) AS consensus, (SELECT count(*) FROM vc WHERE vc.label = f.label AND k > 1.5) AS majority
  FROM (SELECT label, method, count(*) AS found FROM votes WHERE label IN ('bot', 'hub') GROUP BY 1, 2) f)"""

BOTH = "both_ AS (SELECT geo_location, a AS label_a, 'high' AS conf_a, b AS label_b, 'low' AS conf_b FROM ann WHERE a IS NOT NULL AND b IS NOT NULL)"

ENRICH = """places AS (SELECT DISTINCT city, country, CAST(split_part(city, '_', 2) AS BIGINT) AS k FROM t),
cn AS (SELECT country, count(*) AS n FROM t GROUP BY 1),
en0 AS (SELECT city, country, CASE WHEN k % 4 <> 3 THEN k * 7 - 7 ELSE -1 END AS paper_count, k, n AS country_locations FROM places JOIN cn USING (country)),
en1 AS (SELECT *, CASE WHEN paper_count > 100 THEN 'major research hub' WHEN paper_count > 20 THEN 'active research' WHEN paper_count > 5 THEN 'some research'
  WHEN paper_count > 0 THEN 'limited research' WHEN paper_count = 0 THEN 'no publications found' ELSE 'unknown (query failed)' END AS research_level FROM en0),
en AS (SELECT *, 'Research context for ' || city || ', ' || country || ':' || chr(10)
  || CASE WHEN paper_count >= 0 THEN 'Publications: about ' || CAST(paper_count AS VARCHAR) ELSE 'Publications: unknown' END || chr(10)
  || CASE WHEN k % 3 = 0 THEN 'Institutions: Institute ' || CAST(k AS VARCHAR) || ', University' ELSE 'Institutions: none in the list' END || chr(10)
  || 'Assessment: ' || research_level || chr(10) || 'Locations from ' || country || ': ' || CAST(country_locations AS VARCHAR) AS context FROM en1)"""


def _f(col: str, k: int) -> str:
    return f"format('{{:.{k}f}}', round(CAST({col} AS DOUBLE), {k}))"


def oracles() -> dict[str, str]:
    o = {}
    o["src01_log_scan"] = query("orders", [], "SELECT country, method, year, count(*) AS n, count(city) AS cities FROM log GROUP BY 1, 2, 3")
    o["src02_schema_mapping"] = query("orders", [], """SELECT country AS geo_location, year + 1 AS year, count(*) AS n, CAST(0 AS BIGINT) AS cities,
      CAST(0 AS BIGINT) AS projects, CAST(0 AS BIGINT) AS methods FROM log GROUP BY 1, 2""")
    o["src03_project_metadata"] = query("orders", ["top AS (SELECT accession, count(*) AS downloads FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100)"],
      """SELECT t.accession, downloads, p_name AS title, '2020-01-01' AS "submissionDate", p_brand AS "publicationDate" FROM top t
      LEFT JOIN part ON accession = concat('PXD', lpad(CAST(p_partkey AS VARCHAR), 6, '0'))""")
    o["src04_label_table"] = query("orders", [GOLD], "SELECT geo_location, label, split FROM gold")
    o["src05_exact_sample"] = query("events", ["s AS (SELECT * FROM log ORDER BY md5(concat_ws('|', CAST(epoch_us(ts) AS VARCHAR), accession, filename, usr)) LIMIT 1000)"],
      "SELECT country, method, count(*) AS n FROM s GROUP BY 1, 2")
    o["src06_oversampled_limit"] = query("orders", ["s AS (SELECT * FROM log ORDER BY md5(concat_ws('|', CAST(epoch_us(ts) AS VARCHAR), accession, filename, usr)) LIMIT 500)"],
      "SELECT method, count(*) AS n FROM s GROUP BY 1")
    o["src07_capped_sample"] = query("events", [], """SELECT geo_location, usr, accession, us, sample_rank FROM (
      SELECT geo_location, usr, accession, epoch_us(ts) AS us, row_number() OVER (PARTITION BY geo_location
        ORDER BY md5(concat_ws('|', CAST(epoch_us(ts) AS VARCHAR), accession, filename, usr))) AS sample_rank FROM v) WHERE sample_rank <= 50""")
    flags = "coalesce(is_bot, false) AS is_bot, coalesce(is_hub, false) AS is_hub, coalesce(is_organic, true) AS is_organic"
    o["src08_annotated_sink"] = query("orders", LIGHT_LABELS, f"""SELECT is_bot, is_hub, is_organic, count(*) AS n FROM (
      SELECT {flags} FROM log LEFT JOIN lab USING (geo_location)) GROUP BY 1, 2, 3""")
    o["src09_location_sink"] = query("events", [], """SELECT geo_location, CAST(12 AS BIGINT) AS windows, n AS last_downloads FROM (
      SELECT geo_location, n, row_number() OVER (PARTITION BY geo_location ORDER BY week DESC) AS r FROM wk) WHERE r = 1""")
    kinds = ("bot", "hub", "user")
    o["src10_summary_sink"] = query("orders", LIGHT_LABELS, "SELECT 'rules' AS method, count(*) AS total_locations, CAST(sum(total_downloads) AS BIGINT) AS total_downloads, count(DISTINCT country) AS countries, "
      + ", ".join(f"count(CASE WHEN final_label = '{c}' THEN 1 END) AS {c}_locations, CAST(coalesce(sum(CASE WHEN final_label = '{c}' THEN total_downloads END), 0) AS BIGINT) AS {c}_downloads, "
                  f"round(100.0 * coalesce(sum(CASE WHEN final_label = '{c}' THEN total_downloads END), 0) / sum(total_downloads), 6) + 0.0 AS {c}_downloads_pct" for c in kinds) + " FROM lab")
    o["flt01_valid_events"] = query("orders", [], "SELECT year, count(*) AS n FROM v WHERE year >= 1998 GROUP BY 1")
    o["flt02_minimum_volume"] = query("orders", [], "SELECT geo_location, count(*) AS total_downloads FROM vy GROUP BY 1 HAVING count(*) >= 600")
    o["flt03_country_names"] = query("orders", ["""c AS (SELECT CASE k WHEN 0 THEN '%{country}' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'N/A' WHEN 4 THEN 'a{b' ELSE country END AS country
      FROM (SELECT *, CAST(substr(usr, 2) AS BIGINT) % 11 AS k FROM log))"""],
      """SELECT (country IS NOT NULL AND country <> '' AND country NOT LIKE '%{%') AS plain, (country IS NOT NULL AND country <> '' AND NOT contains(country, '%{')
      AND country NOT IN ('N/A', 'Unknown')) AS report, count(*) AS n FROM c GROUP BY 1, 2""")
    o["flt04_category_filters"] = query("orders", LIGHT_LABELS, " UNION ALL ".join(
      f"SELECT '{m}' AS mode, year, count(*) AS n FROM log WHERE geo_location {w} GROUP BY 2" for m, w in (
        ("user_only", "IN (SELECT geo_location FROM lab WHERE NOT is_bot AND NOT is_hub)"), ("hub_only", "IN (SELECT geo_location FROM lab WHERE is_hub)"),
        ("bot_only", "IN (SELECT geo_location FROM lab WHERE is_bot)"), ("no_bots", "NOT IN (SELECT geo_location FROM lab WHERE is_bot)"))))
    o["flt05_complete_cases"] = query("orders", [], """SELECT geo_location, min(country) AS country, count(DISTINCT usr) AS unique_users,
      round(CAST(count(*) AS DOUBLE) / count(DISTINCT usr), 6) AS downloads_per_user FROM vy WHERE length(country) % 3 > 0 GROUP BY 1""")
    cols = RICH_COLUMNS - {"regularity_score", "interval_cv"}
    o["flt06_range_pattern"] = query("orders", LIGHT_TABLE, f"SELECT geo_location, {pattern_sql(PATTERN, cols)} AS matched, false AS absent FROM t")
    o["flt07_any_pattern"] = query("orders", LIGHT_TABLE, f"""SELECT geo_location, ({pattern_sql(PATTERN, cols)} OR night_activity_ratio >= 0.345 OR years_active = 3) AS matched,
      false AS none FROM t""")
    o["flt08_blind_columns"] = query("orders", [BASE], "SELECT geo_location, unique_users, total_downloads, country FROM base")
    o["jn02_semi_join"] = query("orders", LIGHT_LABELS, "SELECT year, count(*) AS n FROM log WHERE geo_location IN (SELECT geo_location FROM lab WHERE is_hub) GROUP BY 1")
    o["jn03_anti_join"] = query("orders", LIGHT_LABELS, "SELECT year, count(*) AS n FROM log WHERE geo_location NOT IN (SELECT geo_location FROM lab WHERE is_bot) GROUP BY 1")
    o["jn04_successor"] = query("orders", ["r AS (SELECT *, row_number() OVER (PARTITION BY geo_location ORDER BY h) AS rn FROM hr)"],
      """SELECT a.geo_location, a.n, epoch_us(CAST(a.h AS TIMESTAMP)) AS hour_us, (epoch_us(CAST(b.h AS TIMESTAMP)) - epoch_us(CAST(a.h AS TIMESTAMP))) / 3600000000e0 AS next_in_hours
      FROM r a LEFT JOIN r b ON a.geo_location = b.geo_location AND b.rn = a.rn + 1""")
    o["jn05_own_group_statistics"] = query("orders", ["m AS (SELECT geo_location, avg(n) AS m FROM dy GROUP BY 1)"],
      "SELECT geo_location, epoch_us(day) AS day_us, n, round(n - m, 6) + 0.0 AS above_mean FROM dy JOIN m USING (geo_location)")
    o["jn06_multi_way"] = query("orders", [DOW, FILE_DIV, SESSION_COUNT, "j AS (SELECT * FROM dow LEFT JOIN filediv USING (geo_location) LEFT JOIN sesscount USING (geo_location))"],
      out("geo_location weekend_ratio:r unique_days_of_week:i unique_files:i file_concentration:r file_diversity_ratio:r num_sessions:i downloads_per_session:r", "j"))
    annotated = f"SELECT country, is_bot, is_hub, is_organic, count(*) AS n FROM (SELECT log.country, {flags} FROM log LEFT JOIN lab USING (geo_location)) GROUP BY 1, 2, 3, 4"
    o["jn07_annotate"] = query("orders", LIGHT_LABELS, annotated)
    o["jn08_annotate_from_keys"] = query("orders", LIGHT_LABELS, """SELECT country, is_bot, is_hub, NOT is_bot AND NOT is_hub AS is_organic, count(*) AS n FROM (
      SELECT country, geo_location IN (SELECT geo_location FROM lab WHERE is_bot) AS is_bot, geo_location IN (SELECT geo_location FROM lab WHERE is_hub) AS is_hub FROM log) GROUP BY 1, 2, 3, 4""")
    o["jn09_annotator_pairs"] = query(None, [ANNOTATORS, BOTH], "SELECT * FROM both_")
    o["jn10_gold_match"] = query("orders", [GOLD], """SELECT geo_location, n AS total_downloads, label, split FROM gold
      JOIN (SELECT geo_location, count(*) AS n FROM vy GROUP BY 1) USING (geo_location)""")
    hav = ("2 * 6371 * asin(sqrt(least(1, power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) "
           "* power(sin(radians({b}.lon - {a}.lon) / 2), 2))))")
    order = "row_number() OVER (ORDER BY total_downloads DESC, geo_location) AS rank"
    greedy = [f"""g(i, ls) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(geo_location VARCHAR, country VARCHAR, lat DOUBLE, lon DOUBLE, rank BIGINT)[])
        UNION ALL SELECT g.i + 1, CASE WHEN len(list_filter(g.ls, lambda l: l.country = p.country AND {hav.format(a='l', b='p')} <= 10)) > 0 THEN g.ls
          ELSE list_append(g.ls, struct_pack(geo_location := p.geo_location, country := p.country, lat := p.lat, lon := p.lon, rank := p.rank)) END
        FROM g JOIN pts p ON p.rank = g.i + 1)""",
      "lead AS (SELECT unnest(ls, recursive := true) FROM (SELECT ls FROM g ORDER BY i DESC LIMIT 1))",
      f"""grp AS (SELECT p.geo_location, p.country, arg_min(l.geo_location, l.rank) AS leader_location FROM pts p JOIN lead l ON l.country = p.country AND l.rank <= p.rank
        AND {hav.format(a='l', b='p')} <= 10 GROUP BY 1, 2)"""]
    coords = "CAST(split_part(geo_location, ',', 1) AS DOUBLE) AS lat, CAST(split_part(geo_location, ',', 2) AS DOUBLE) AS lon"

    def recursive(sql: str) -> str:
        return "WITH RECURSIVE " + sql[len("WITH "):]
    o["jn11_proximity_groups"] = recursive(query("orders", [
        BASE, f"pts AS (SELECT geo_location, country, {coords}, {order} FROM base)", *greedy], "SELECT * FROM grp"))
    o["rpt11_consolidated_hubs"] = recursive(query("orders", LIGHT_LABELS + [
        f"pts AS (SELECT geo_location, country, {coords}, {order} FROM lab WHERE is_hub)", *greedy,
        "mem AS (SELECT g.country, g.leader_location, l.* EXCLUDE (country) FROM grp g JOIN lab l USING (geo_location))",
        """cit AS (SELECT country, leader_location, string_agg(city, ', ' ORDER BY city) AS cities FROM (SELECT DISTINCT country, leader_location, city,
          dense_rank() OVER (PARTITION BY country, leader_location ORDER BY city) AS r FROM mem) WHERE r <= 3 GROUP BY 1, 2)"""],
        """SELECT m.country, m.leader_location, num_locations, total_users, total_downloads, cities, downloads_per_user FROM (SELECT country, leader_location, count(*) AS num_locations,
          CAST(sum(unique_users) AS BIGINT) AS total_users, CAST(sum(total_downloads) AS BIGINT) AS total_downloads, round(sum(total_downloads) / CAST(sum(unique_users) AS DOUBLE), 6) AS downloads_per_user
          FROM mem GROUP BY 1, 2) m JOIN cit USING (country, leader_location)"""))
    o["jn12_country_statistics"] = query("orders", [BASE], """SELECT geo_location, country, total_downloads, count(*) OVER (PARTITION BY country) AS locations_per_country,
      CAST(sum(total_downloads) OVER (PARTITION BY country) AS BIGINT) AS country_total_dl FROM base""")
    flags_sql = ", ".join(f"{pattern_sql(p)} AS {lv}__{kd}__{p['id']}" for lv, kds in RICH.taxonomy.items() for kd, ps in kds.items() for p in ps)
    o["cls01_matched_patterns"] = query("orders", WHOLE_TABLE, f"SELECT geo_location, {flags_sql} FROM t")
    o["cls02_behavior_type"] = query("orders", RICH_LABELS, "SELECT geo_location, behavior_type FROM bt")
    o["cls03_automation_category"] = query("orders", RICH_LABELS, "SELECT geo_location, behavior_type, automation_category FROM ac")
    o["cls04_rule_confidence"] = query("orders", RICH_LABELS, f"SELECT geo_location, round({CONFIDENCE}, 6) + 0.0 AS classification_confidence FROM ac")
    bools = ("coalesce(automation_category = 'bot', false) AS is_bot, coalesce(automation_category = 'legitimate_automation', false) AS is_hub, behavior_type = '{}' AS is_organic")
    o["cls05_boolean_labels"] = query("orders", RICH_LABELS, f"SELECT geo_location, behavior_type, automation_category, {bools.format('organic')} FROM ac")
    o["cls06_rule_classifier"] = query("orders", WHOLE_LABELS, """SELECT geo_location, behavior_type, automation_category, is_bot, is_hub, is_organic, is_protected_hub,
      round(classification_confidence, 6) + 0.0 AS classification_confidence FROM lab""")
    for key, cte in (("cls07_organic_seeds", "oseed"), ("cls08_bot_seeds", "bseed"), ("cls09_hub_seeds", "hseed")):
        o[key] = query("orders", RICH_TABLE + seed_ctes(), f"SELECT geo_location, CAST(seed_confidence AS DOUBLE) AS seed_confidence FROM {cte}")
    o["cls10_seed_overlap"] = query("orders", RICH_TABLE + seed_ctes(), "SELECT geo_location, label, CAST(seed_confidence AS DOUBLE) AS seed_confidence FROM seeds")
    o["cls11_label_injection"] = query("orders", RICH_TABLE + seed_ctes(), "SELECT geo_location, label, CAST(seed_confidence AS DOUBLE) AS seed_confidence FROM injected")
    have = [c for c in MODEL_FEATURES if c in {
        "unique_users", "downloads_per_user", "total_downloads", "working_hours_ratio", "night_activity_ratio", "hourly_entropy", "burst_pattern_score",
        "user_coordination_score", "spike_ratio", "fraction_latest_year", "year_over_year_cv", "years_span", "protocol_legitimacy_score", "aspera_ratio",
        "globus_ratio", "regularity_score", "unique_projects", "top_project_concentration", "top3_project_concentration", "project_hhi"}]
    o["cls12_feature_matrix"] = query("orders", WHOLE_TABLE, out("geo_location " + " ".join(f"{c}:r" for c in have), "t"))
    o["cls14_hub_protection"] = query("orders", RICH_LABELS, "SELECT geo_location, behavior_type, automation_category, is_protected_hub FROM hp")
    o["cls15_hub_demotion"] = query("orders", WHOLE_LABELS, "SELECT geo_location, behavior_type, automation_category, is_protected_hub FROM hd")
    mapped = """mp AS (SELECT *, CASE WHEN night_activity_ratio > 0.34 THEN 'bot' WHEN working_hours_ratio > 0.35 THEN 'hub' ELSE 'organic' END AS l FROM t),
      mq AS (SELECT geo_location, total_downloads, CASE WHEN l = 'bot' THEN 'bot' WHEN l = 'hub' THEN 'download_hub' WHEN unique_users <= 10 AND downloads_per_user <= 5 THEN 'independent_user' ELSE 'normal' END AS user_category,
        CASE WHEN l = 'organic' THEN 'user' ELSE l END AS behavior_type, CASE WHEN l = 'bot' THEN 'bot' WHEN l = 'hub' THEN 'legitimate_automation' END AS automation_category,
        working_hours_ratio * 1.5 < 0.5 AS needs_review FROM mp)"""
    o["cls18_label_mapping"] = query("orders", LIGHT_TABLE + [mapped], "SELECT geo_location, user_category, behavior_type, automation_category, needs_review FROM mq")
    o["cls19_finalise"] = query("orders", LIGHT_TABLE + [mapped, """fin AS (SELECT geo_location, CASE WHEN total_downloads < 600 THEN 'insufficient_evidence' ELSE behavior_type END AS behavior_type,
      CASE WHEN total_downloads >= 600 THEN automation_category END AS automation_category FROM mq)"""],
      f"SELECT geo_location, behavior_type, automation_category, {bools.format('user')} FROM fin")
    truth = lambda attr, other, q="'": "CASE " + " ".join(
        f"WHEN {' AND '.join(f'{c} {op} {x}' for c, op, x in r.bounds)} THEN {q}{getattr(r, attr)}{q}" for r in TRUTH) + f" ELSE {q}{other}{q} END"
    o["cls25_heuristic_truth"] = query("orders", ["""pf AS (SELECT geo_location, count(*) AS total_downloads, count(DISTINCT usr) AS unique_users,
      CAST(count(*) AS DOUBLE) / count(DISTINCT usr) AS downloads_per_user, avg(CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 1.0 ELSE 0.0 END) AS working_hours_ratio,
      avg(CASE WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 1.0 ELSE 0.0 END) AS night_activity_ratio FROM log GROUP BY 1 HAVING count(*) >= 10)"""],
      f"""SELECT geo_location, {truth('label', 'uncertain')} AS ground_truth_label, CAST({truth('confidence', 0.0, '')} AS DOUBLE) AS ground_truth_confidence,
      {truth('criteria', '')} AS ground_truth_criteria FROM pf""")
    o["cls26_final_label"] = query("orders", LIGHT_LABELS, "SELECT geo_location, final_label FROM lab")
    o["set03_seed_sets"] = query("orders", RICH_TABLE + seed_ctes(), "SELECT label, CAST(seed_confidence AS DOUBLE) AS seed_confidence, count(*) AS n FROM seeds GROUP BY 1, 2")
    o["set05_label_override"] = query("orders", RICH_TABLE + seed_ctes(), "SELECT label, count(*) AS n FROM injected GROUP BY 1")
    o["set04_vote_sets"] = o["evl09_discovery"] = query(None, [ANNOTATORS, VOTES, DISCOVERY], "SELECT * FROM disc")
    o["evl01_unified_label"] = query("orders", RICH_LABELS, """SELECT geo_location, CASE WHEN is_bot THEN 'bot' WHEN automation_category = 'bot' THEN 'bot'
      WHEN automation_category = 'legitimate_automation' THEN 'hub' WHEN behavior_type IN ('bot', 'hub') THEN behavior_type ELSE 'user' END AS label FROM lab""")
    o["evl02_align"] = query(None, [ANNOTATORS, PAIRS], "SELECT * FROM pairs")
    mcols = "tp fp fn tn total precision:r recall:r accuracy:r f1:r"
    o["evl03_class_metrics"] = query(None, [ANNOTATORS, PAIRS, CLASSES, metrics("pairs", "m")], out("class " + mcols, "m"))
    o["evl03_macro_metrics"] = query(None, [ANNOTATORS, PAIRS, CLASSES, metrics("pairs", "m")], """SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1,
      round((SELECT avg(CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END) FROM pairs), 6) AS accuracy FROM m""")
    o["evl05_agreement"] = query(None, [ANNOTATORS, PAIRS, CLASSES], """SELECT class, round(coalesce(CAST(count(CASE WHEN pred = class AND truth = class THEN 1 END) AS DOUBLE)
      / NULLIF(count(CASE WHEN pred = class OR truth = class THEN 1 END), 0), 1), 6) AS jaccard, round(avg(CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END), 6) AS overall FROM pairs, cls GROUP BY 1""")
    o["evl06_kappa"] = query(None, [ANNOTATORS, PAIRS, """kp AS (SELECT count(*) AS n, avg(CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END) AS observed,
      (SELECT sum((SELECT count(*) FROM pairs WHERE pred = c) * (SELECT count(*) FROM pairs WHERE truth = c) / power((SELECT count(*) FROM pairs), 2)) FROM (SELECT unnest(['bot', 'hub', 'user']) AS c)) AS expected FROM pairs)"""],
      "SELECT n, round(observed, 6) AS observed, round(expected, 6) AS expected, round((observed - expected) / (1 - expected), 6) AS kappa FROM kp")
    o["evl07_mcnemar"] = query(None, [ANNOTATORS, """tr AS (SELECT coalesce(replace(a, 'organic', 'user'), 'user') = truth AS x, coalesce(replace(b, 'organic', 'user'), 'user') = truth AS y FROM ann),
      mc AS (SELECT count(CASE WHEN x AND NOT y THEN 1 END) AS first_only, count(CASE WHEN NOT x AND y THEN 1 END) AS second_only, count(CASE WHEN x AND y THEN 1 END) AS both_correct,
        count(CASE WHEN NOT x AND NOT y THEN 1 END) AS both_wrong FROM tr)"""],
      "SELECT *, round(coalesce(power(abs(first_only - second_only) - 1, 2) / NULLIF(first_only + second_only, 0), 0), 6) AS chi2 FROM mc")
    shares = ", ".join([f"count(CASE WHEN label = '{c}' THEN 1 END) AS {c}_locations, round(100.0 * coalesce(sum(CASE WHEN label = '{c}' THEN total_downloads END), 0) / sum(total_downloads), 6) AS {c}_dl_pct" for c in kinds])
    quality = ", ".join(f"round(max(CASE WHEN class = '{c}' THEN {m} END), 6) AS {c}_{m}" for c in kinds for m in ("precision", "recall", "f1"))
    o["evl08_method_comparison"] = query(None, [ANNOTATORS, VOTES, CLASSES, "vp AS (SELECT method, label AS pred, truth FROM votes JOIN ann USING (geo_location))", metrics("vp", "m", "method")],
      f"""SELECT * FROM (SELECT method, count(*) AS locations, {shares} FROM votes GROUP BY 1) JOIN (SELECT method, {quality}, round(avg(f1), 6) AS macro_f1 FROM m GROUP BY 1) USING (method)""")
    o["evl10_majority_consistency"] = query(None, [ANNOTATORS, VOTES, """mj AS (SELECT geo_location, label AS majority FROM (SELECT geo_location, label,
      row_number() OVER (PARTITION BY geo_location ORDER BY count(*) DESC, label) AS r FROM votes GROUP BY 1, 2) WHERE r = 1)"""],
      "SELECT method, round(avg(CASE WHEN label = majority THEN 1.0 ELSE 0.0 END), 6) AS consistency FROM votes JOIN mj USING (geo_location) GROUP BY 1")
    o["evl11_confidence"] = query(None, [ANNOTATORS, VOTES, """cf AS (SELECT method, avg(c) AS mean, stddev_samp(c) AS std, min(c) AS min, max(c) AS max, quantile_cont(c, 0.25) AS q25,
      quantile_cont(c, 0.5) AS median, quantile_cont(c, 0.75) AS q75 FROM (SELECT method, CAST(confidence AS DOUBLE) AS c FROM votes) GROUP BY 1)"""],
      out("method mean:r std:r min:r max:r q25:r median:r q75:r", "cf"))
    o["evl12_download_impact"] = query(None, [ANNOTATORS, VOTES], """SELECT method, label, count(*) AS locations, CAST(sum(total_downloads) AS BIGINT) AS downloads,
      round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY method), 6) AS locations_pct, round(100.0 * sum(total_downloads) / sum(sum(total_downloads)) OVER (PARTITION BY method), 6) AS downloads_pct
      FROM votes GROUP BY 1, 2""")
    o["evl13_consensus"] = query(None, [ANNOTATORS, BOTH], """SELECT *, CASE WHEN label_a = label_b THEN label_a END AS consensus_label,
      CASE WHEN label_a = label_b THEN 'agree' ELSE 'disagree' END AS agreement FROM both_""")
    o["evl14_annotator_agreement"] = query(None, [ANNOTATORS, BOTH, "cl AS (SELECT unnest(['bot', 'hub', 'organic']) AS class)"], """SELECT class,
      round(coalesce(CAST(count(CASE WHEN label_a = class AND label_b = class THEN 1 END) AS DOUBLE) / NULLIF(count(CASE WHEN label_a = class OR label_b = class THEN 1 END), 0), 0), 6) AS agreement_rate,
      count(CASE WHEN label_a = class THEN 1 END) AS count_a, count(CASE WHEN label_b = class THEN 1 END) AS count_b FROM both_, cl GROUP BY 1""")
    o["evl15_disagreements"] = query(None, [ANNOTATORS, BOTH], "SELECT label_a || '->' || label_b AS pattern, count(*) AS n FROM both_ WHERE label_a <> label_b GROUP BY 1")
    o["evl16_stratified_split"] = """SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id)
      <= ceil(count(*) OVER (PARTITION BY lang) * 0.33e0) THEN 'test' ELSE 'train' END AS split FROM documents"""
    hold = "{n}p AS (SELECT truth, replace({c}, 'organic', 'user') AS pred FROM ann WHERE {c} IS NOT NULL)"
    o["evl17_holdout"] = query(None, [ANNOTATORS, CLASSES, hold.format(n="a", c="a"), metrics("ap", "m")], out("class " + mcols, "m"))
    names = ("precision", "recall", "f1")
    o["evl18_run_delta"] = query(None, [ANNOTATORS, CLASSES, hold.format(n="a", c="a"), hold.format(n="b", c="b"), metrics("ap", "x"), metrics("bp", "y")],
      "SELECT x.class, " + ", ".join(f"round(x.{m}, 6) AS base_{m}, round(y.{m}, 6) AS new_{m}, round(y.{m} - x.{m}, 6) + 0.0 AS delta_{m}" for m in names)
      + ", (SELECT count(*) FROM ann WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b) AS changed FROM x JOIN y USING (class)")
    pct = lambda num, den: f"round(coalesce(100.0 * ({num}) / NULLIF({den}, 0), 0), 6) + 0.0"
    o["evl19_run_summary"] = query("orders", LIGHT_LABELS, "SELECT 'rules' AS method, count(*) AS locations, CAST(sum(total_downloads) AS BIGINT) AS total_downloads, count(DISTINCT country) AS countries, "
      + ", ".join(f"count(CASE WHEN final_label = '{c}' THEN 1 END) AS {c}_locations, CAST(coalesce(sum(CASE WHEN final_label = '{c}' THEN total_downloads END), 0) AS BIGINT) AS {c}_downloads, "
        f"{pct(chr(99) + f'ount(CASE WHEN final_label = {chr(39)}{c}{chr(39)} THEN 1 END)', 'count(*)')} AS {c}_pct, "
        f"{pct(f'sum(CASE WHEN final_label = {chr(39)}{c}{chr(39)} THEN total_downloads ELSE 0 END)', 'sum(total_downloads)')} AS {c}_dl_pct" for c in kinds) + " FROM lab")
    o["agp14_crosstab"] = query(None, [ANNOTATORS, BOTH], "SELECT label_a, " + ", ".join(f"count(CASE WHEN label_b = '{c}' THEN 1 END) AS b_{c}" for c in ("bot", "hub", "organic")) + " FROM both_ GROUP BY 1")
    o["ann05_enrichment"] = query("orders", LIGHT_TABLE + [ENRICH], "SELECT city, country, paper_count, research_level, country_locations, context FROM en")
    lines = ["'Location: ' || geo_location", "'City: ' || city", "'Country: ' || country", "'Unique users: ' || CAST(unique_users AS VARCHAR)",
             f"'Downloads per user: ' || {_f('downloads_per_user', 1)}", "'Total downloads: ' || CAST(total_downloads AS VARCHAR)", "'Unique datasets: ' || CAST(unique_projects AS VARCHAR)",
             f"'Working hours ratio: ' || {_f('working_hours_ratio', 2)}", f"'Night activity ratio: ' || {_f('night_activity_ratio', 2)}", f"'Hourly entropy: ' || {_f('hourly_entropy', 2)}",
             "'Years with activity: 0'", "'Fraction in latest year: 0.00'", "'Spike ratio: 0.0'", f"'Aspera share: ' || {_f('aspera_ratio', 3)}", f"'Globus share: ' || {_f('globus_ratio', 3)}",
             "'User entropy: 0.00'", "'User Gini: 0.00'",
             "CASE WHEN e.paper_count > 20 THEN context ELSE 'Research context for ' || city || ', ' || country || ': No enrichment data available.' END"]
    o["ann01_request_texts"] = query("orders", LIGHT_TABLE + [PROTOCOL, ENRICH], f"SELECT geo_location, concat_ws(chr(10), {', '.join(lines)}) AS text FROM t JOIN protocol USING (geo_location) JOIN en e USING (city, country)")
    o["ann02_batches"] = query("orders", [BASE, "nb AS (SELECT geo_location, (row_number() OVER (ORDER BY geo_location) - 1) // 50 AS batch FROM base)"],
      "SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n_locations, string_agg(geo_location, '|' ORDER BY geo_location) AS locations FROM nb GROUP BY 1")
    o["ann03_responses"] = """WITH r AS (SELECT conv_id, turn, concat_ws(chr(10), text, CASE conv_id % 6 WHEN 0 THEN 'LABEL: bot' WHEN 1 THEN 'label:  Hub' WHEN 2 THEN 'Label: USER' WHEN 3 THEN 'LABEL: organic' ELSE 'no verdict' END,
        CASE turn % 3 WHEN 0 THEN 'CONFIDENCE: High' WHEN 1 THEN 'confidence: low' ELSE '' END,
        'REASONING: turn ' || CAST(turn AS VARCHAR) || chr(10) || 'of ' || role || CASE WHEN conv_id % 6 < 3 THEN chr(10) || chr(10) || 'tail' ELSE '' END) AS text FROM conversations),
      p AS (SELECT conv_id, turn, nullif(lower(regexp_extract(text, '(?i)LABEL:\\s*(bot|hub|organic|user)', 1)), '') AS label,
        nullif(lower(regexp_extract(text, '(?i)CONFIDENCE:\\s*(high|medium|low)', 1)), '') AS confidence, nullif(trim(regexp_extract(text, '(?s)REASONING:\\s*(.+?)(?:\\n\\n|\\z)', 1)), '') AS reasoning FROM r)
      SELECT conv_id, turn, CASE WHEN label = 'user' THEN 'organic' ELSE label END AS label, confidence, reasoning FROM p"""
    o["ann04_unprocessed"] = query("orders", [], "SELECT geo_location, count(*) AS total_downloads FROM vy WHERE substr(md5(geo_location), 1, 1) >= '8' GROUP BY 1")
    return o
