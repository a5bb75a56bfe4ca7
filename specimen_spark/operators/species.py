"""Species checklist, gap analysis, family summary."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimen_spark.functions.text import not_blank, trimws
from specimen_spark.functions.windows import first_per_key
from specimen_spark.schema import column_or_null


def _mean(score="score", scored="scored"):
    return F.round(F.try_divide(F.sum(score), F.sum(scored)), 2).alias("mean_quality_score")


def _counted(df: DataFrame, *keys) -> DataFrame:
    """Rows and score sums per combination: the one pass over the rows."""
    score = column_or_null(df, "quality_score")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(score).alias("score"), F.count(score).alias("scored")
    )


def species_checklist(df: DataFrame, grades: DataFrame | None = None) -> DataFrame:
    """One row per non-null species (blank is a species here), sorted by species.

    BIN and country lists are sorted. Per-species sets are built from the distinct
    (species, BIN, country) combinations, not from the rows.
    """
    combos = _counted(df.filter(F.col("species").isNotNull()), "species", "bin_uri", "country_ocean")
    bins = F.array_sort(F.collect_set(F.when(not_blank("bin_uri"), F.col("bin_uri"))))
    countries = F.array_sort(
        F.collect_set(F.when(not_blank("country_ocean"), F.col("country_ocean")))
    )
    per_species = combos.groupBy("species").agg(
        F.sum("n").alias("specimen_count"),
        bins.alias("_bins"),
        countries.alias("_countries"),
        _mean(),
    )
    if grades is None:
        graded = per_species.withColumn("bags_grade", F.lit(""))
    else:
        graded = per_species.join(grades.select("species", "bags_grade"), "species", "left")
    return graded.select(
        "species",
        "specimen_count",
        F.size("_bins").cast("long").alias("bin_count"),
        F.array_join("_bins", "; ").alias("bin_uris"),
        F.coalesce("bags_grade", F.lit("")).alias("bags_grade"),
        F.array_join("_countries", "; ").alias("countries"),
        "mean_quality_score",
    ).orderBy("species")


def checklist_summary(checklist: DataFrame) -> DataFrame:
    return checklist.agg(
        F.count(F.lit(1)).alias("total_species"),
        F.count_if(F.col("bin_count") > 0).alias("species_with_bins"),
        F.count_if(F.col("bin_count") == 0).alias("species_without_bins"),
    )


#: Note of the gap report where there are no specimens at all.
NO_SPECIMENS = "There are no specimens to compare with"


def gap_analysis(groups: DataFrame, df: DataFrame) -> DataFrame:
    """Found / Missing per taxon group; the valid name is tried first, then the synonyms.

    Names compare ignoring case. Specimens are counted per name before the join, so the
    join sees one row per name however many records a species has. ``matched_species`` is
    the lowest spelling (there is no first row in Spark). Without any specimen every group is
    Missing with a note that says so.
    """
    nothing = df.agg(F.count(F.lit(1)).alias("n")).scalar() == 0
    counted = (
        df.filter(F.col("species").isNotNull())
        .groupBy("species").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.lower("species").alias("_name"))
        .agg(F.min("species").alias("matched_species"), F.sum("n").alias("n"))
    )
    names = groups.select("group_id", "pos", trimws("name").alias("name")).filter("name <> ''")
    hits = names.join(counted, F.lower("name") == F.col("_name"))
    best = first_per_key(hits, "group_id", [F.col("pos")]).select(
        "group_id", F.col("name").alias("_hit"), "matched_species", "n"
    )
    firsts = groups.filter("pos = 0").select("group_id", "label", F.col("name").alias("_valid"))
    return firsts.join(best, "group_id", "left").select(
        "group_id",
        F.col("label").alias("input_taxon"),
        F.when(F.col("n").isNotNull(), "Found").otherwise("Missing").alias("status"),
        F.coalesce("matched_species", F.lit("")).alias("matched_species"),
        F.coalesce("n", F.lit(0)).alias("specimen_count"),
        F.when(F.col("_hit") != F.col("_valid"),
               F.concat(F.lit("Matched via synonym: "), F.col("_hit")))
        .when(nothing, NO_SPECIMENS).otherwise("").alias("notes"),
    )


def gap_summary(gaps: DataFrame) -> DataFrame:
    return gaps.agg(
        F.count_if(F.col("status") == "Found").alias("found"), F.count(F.lit(1)).alias("total")
    )


def family_summary(df: DataFrame) -> DataFrame:
    """One row per non-null family, most species first.

    ``order`` is the lowest value (there is no first row in Spark). Blank counts as a
    species and as a country, not as a BIN.
    """
    rows = df.filter(F.col("family").isNotNull()).select(
        "family", column_or_null(df, "order").alias("order"), "species",
        F.when(not_blank("bin_uri"), F.col("bin_uri")).alias("bin_uri"), "country_ocean",
        column_or_null(df, "quality_score").alias("quality_score"),
    )
    combos = _counted(rows, "family", "order", "species", "bin_uri", "country_ocean")
    return (
        combos.groupBy("family")
        .agg(
            F.min("order").alias("order"),
            F.count_distinct("species").alias("species_count"),
            F.sum("n").alias("specimen_count"),
            F.count_distinct("bin_uri").alias("bin_count"),
            _mean(),
            F.count_distinct("country_ocean").alias("countries"),
        )
        .orderBy(F.col("species_count").desc(), "family")
    )
