"""Texts for blind annotation of locations and parsing of the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions.columns import LOC
from logtide.functions.ranks import sliced_row_number

# Columns a blind annotator must not see.
BLIND_COLUMNS = [
    "behavior_type", "automation_category", "user_category", "is_bot", "is_hub", "is_organic",
    "is_protected_hub", "classification_confidence", "prob_bot", "prob_hub", "prob_organic",
    "needs_review", "final_label", "predicted_label",
]

# Fixed order of the described features: column, caption, number of decimals.
DESCRIBED = [
    ("unique_users", "Unique users", 0),
    ("downloads_per_user", "Downloads per user", 1),
    ("total_downloads", "Total downloads", 0),
    ("unique_projects", "Unique datasets", 0),
    ("working_hours_ratio", "Working hours ratio", 2),
    ("night_activity_ratio", "Night activity ratio", 2),
    ("hourly_entropy", "Hourly entropy", 2),
    ("years_span", "Years with activity", 0),
    ("fraction_latest_year", "Fraction in latest year", 2),
    ("spike_ratio", "Spike ratio", 1),
    ("aspera_ratio", "Aspera share", 3),
    ("globus_ratio", "Globus share", 3),
    ("user_entropy", "User entropy", 2),
    ("user_gini_coefficient", "User Gini", 2),
]


def blind(locations: DataFrame) -> DataFrame:
    return locations.drop(*BLIND_COLUMNS)


def _number(df: DataFrame, name: str, decimals: int) -> Column:
    value = F.col(name) if name in df.columns else F.lit(None)
    value = F.coalesce(value.cast("double"), F.lit(0.0))
    if decimals == 0:
        return value.cast("bigint").cast("string")
    return F.format_string(f"%.{decimals}f", F.round(value, decimals))


def request_texts(locations: DataFrame, enrichment: DataFrame) -> DataFrame:
    """(location, text): place, feature lines and the research context of the place.

    ``enrichment``: city, country, context. A place without context says so.
    """
    rows = blind(locations).join(enrichment.select("city", "country", "context"),
                                 ["city", "country"], "left")
    nothing = F.concat(F.lit("Research context for "), F.coalesce("city", F.lit("")), F.lit(", "),
                       F.coalesce("country", F.lit("")), F.lit(": No enrichment data available."))
    lines = [F.concat(F.lit("Location: "), F.col(LOC)),
             F.concat(F.lit("City: "), F.coalesce("city", F.lit(""))),
             F.concat(F.lit("Country: "), F.coalesce("country", F.lit("")))]
    lines += [F.concat(F.lit(f"{caption}: "), _number(rows, name, k))
              for name, caption, k in DESCRIBED]
    return rows.select(LOC, F.concat_ws("\n", *lines, F.coalesce("context", nothing))
                       .alias("text"))


def batches(texts: DataFrame, size: int = 50) -> DataFrame:
    """Texts with their batch number, in location order."""
    numbered = sliced_row_number(texts, [], F.col(LOC), "rn")
    return numbered.withColumn("batch", F.floor((F.col("rn") - 1) / size).cast("bigint"))


def manifest(batched: DataFrame) -> DataFrame:
    """One row per batch with its locations in order (a batch is small by construction)."""
    return batched.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_locations"),
        F.transform(F.array_sort(F.collect_list(F.struct("rn", LOC))), lambda s: s[LOC])
        .alias("locations"))


def parse_responses(responses: DataFrame, column: str = "text") -> DataFrame:
    """LABEL and CONFIDENCE in any case, REASONING up to the first blank line.

    ``user`` is accepted for ``organic``; what is not found is NULL.
    """
    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))
    label = F.lower(found(r"(?i)LABEL:\s*(bot|hub|organic|user)"))
    return responses.withColumns({
        "label": F.when(label == "user", "organic").otherwise(label),
        "confidence": F.lower(found(r"(?i)CONFIDENCE:\s*(high|medium|low)")),
        "reasoning": F.trim(found(r"(?s)REASONING:\s*(.+?)(?:\n\n|\z)")),
    })


def unprocessed(locations: DataFrame, done: DataFrame) -> DataFrame:
    return locations.join(done.select(LOC), LOC, "left_anti")


def research_level(papers: Column) -> Column:
    return F.when(papers > 100, "major research hub").when(papers > 20, "active research") \
        .when(papers > 5, "some research").when(papers > 0, "limited research") \
        .when(papers == 0, "no publications found").otherwise("unknown (query failed)")


def enrichment(locations: DataFrame, papers: DataFrame, institutions: DataFrame) -> DataFrame:
    """Context of every (city, country): publications, institutions, locations per country.

    ``papers``: city, country, paper_count (-1 or absent is unknown); ``institutions``: city,
    names (array).
    """
    per_country = locations.filter(F.col("country").isNotNull()).groupBy("country").agg(
        F.count(F.lit(1)).alias("country_locations"))
    places = locations.select("city", "country").distinct()
    rows = (places.join(papers, ["city", "country"], "left").join(institutions, "city", "left")
            .join(per_country, "country", "left")
            .withColumn("paper_count", F.coalesce("paper_count", F.lit(-1))))
    count, names = F.col("paper_count"), F.col("names")
    level = research_level(count)
    here = F.coalesce("country_locations", F.lit(0))
    publications = F.when(count >= 0, F.concat(F.lit("Publications: about "),
                                               count.cast("string"))) \
        .otherwise("Publications: unknown")
    known = F.when(F.size(names) > 0, F.concat(F.lit("Institutions: "),
                                               F.array_join(names, ", "))) \
        .otherwise("Institutions: none in the list")
    context = F.concat_ws(
        "\n", F.concat(F.lit("Research context for "), F.col("city"), F.lit(", "),
                       F.col("country"), F.lit(":")),
        publications, known, F.concat(F.lit("Assessment: "), level),
        F.concat(F.lit("Locations from "), F.col("country"), F.lit(": "),
                 here.cast("string")))
    return rows.select("city", "country", count.cast("bigint").alias("paper_count"),
                       level.alias("research_level"), here.alias("country_locations"),
                       context.alias("context"))
