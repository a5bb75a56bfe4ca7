"""Grade views: members of a grade, groupings, order, info, captions, metrics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimen_spark.functions.skew import join_spread
from specimen_spark.functions.text import count_distinct_null_as_value, not_blank
from specimen_spark.functions.windows import first_per_key, with_position
from specimen_spark.operators.grade import has_species_rank, is_species_level


def grade_members(df: DataFrame, grades: DataFrame, grade=None, tie=None) -> DataFrame:
    """Rows a curator sees for a grade, with their ``bags_grade``.

    Species-rank rows (by ``identification_rank``) of the grade's species that have a BIN,
    and rows of other ranks in those BINs. ``grade`` is one grade, a list, or None for all;
    a row of another rank appears once per grade that holds its BIN. Without a rank column
    the view is empty. ``tie`` dedupes keys, which imported data does not need.
    """
    wanted = grades.select("species", "bags_grade")
    if grade is not None:
        wanted = wanted.filter(
            F.col("bags_grade").isin([grade] if isinstance(grade, str) else list(grade))
        )
    if "identification_rank" not in df.columns:
        return df.withColumn("bags_grade", F.lit(None).cast("string")).filter(F.lit(False))
    binned = df.filter(not_blank("bin_uri"))
    ranked = binned.filter(has_species_rank())
    of_species = join_spread(ranked, wanted, "species")
    # reduced to distinct pairs before the join, so a large species costs one pair per BIN
    grade_bins = (
        ranked.select("species", "bin_uri").distinct().join(wanted, "species")
        .select("bin_uri", "bags_grade").distinct()
    )
    of_bins = join_spread(binned.filter(~has_species_rank()), grade_bins, "bin_uri")
    members = of_species.select(*df.columns, "bags_grade").unionByName(
        of_bins.select(*df.columns, "bags_grade")
    )
    if tie:
        members = first_per_key(members, ["bags_grade", "processid"], [F.col(t) for t in tie])
    return members


def _split(df: DataFrame):
    level = is_species_level(df)
    return df.filter(level), df.filter(~level)


def group_by_species(df: DataFrame) -> DataFrame:
    """Groups of grades A, B and D: one per species, with the other-rank rows of its BINs.

    Adds ``group_key`` and ``group_species``. A row of another rank joins every group that
    holds its BIN; inside these grades no two species share a BIN, so that is one group.
    """
    named, others = _split(df)
    species_bins = (
        named.filter(not_blank("bin_uri"))
        .select(F.col("species").alias("group_species"), "bin_uri")
        .distinct()
    )
    joined = join_spread(others, species_bins, "bin_uri").select(*df.columns, "group_species")
    return (
        named.withColumn("group_species", F.col("species"))
        .unionByName(joined)
        .withColumn("group_key", F.col("group_species"))
    )


def group_by_species_bin(df: DataFrame) -> DataFrame:
    """Groups of grade C: one per species and BIN, with the other-rank rows of that BIN."""
    named, others = _split(df.filter(not_blank("bin_uri")))
    species_bins = named.select(F.col("species").alias("group_species"), "bin_uri").distinct()
    joined = join_spread(others, species_bins, "bin_uri").select(*df.columns, "group_species")
    return (
        named.withColumn("group_species", F.col("species"))
        .unionByName(joined)
        .withColumn("group_bin", F.col("bin_uri"))
        .withColumn("group_key", F.concat_ws("_", "group_species", "group_bin"))
    )


def group_by_shared_bin(df: DataFrame) -> DataFrame:
    """Groups of grade E: BINs with more than one species-level species, all their rows."""
    named, _ = _split(df.filter(not_blank("bin_uri")))
    shared = (
        named.select("bin_uri", "species").distinct().groupBy("bin_uri")
        .agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("bin_uri")
    )
    return (
        df.join(shared, "bin_uri", "left_semi")
        .select(*df.columns)
        .withColumn("group_bin", F.col("bin_uri"))
        .withColumn("group_key", F.col("bin_uri"))
    )


def group_order(groups: DataFrame) -> DataFrame:
    """Adds ``pos``: score descending inside each group, ties by ``processid``."""
    return with_position(groups, "group_key", "quality_score", "processid")


def group_info(groups: DataFrame, grade: str) -> DataFrame:
    """One row per group: species, BIN and counts as the grade calls for."""
    if grade in ("A", "B", "D"):
        return groups.groupBy("group_key", "group_species").agg(
            F.count(F.lit(1)).alias("specimen_count")
        )
    if grade == "C":
        return groups.groupBy("group_key", "group_species", "group_bin").agg(
            F.count(F.lit(1)).alias("specimen_count")
        )
    # grade E: rows per (BIN, species) first; the name list holds each species once
    level = is_species_level(groups)
    per_name = groups.groupBy(
        "group_key", "group_bin", F.when(level, F.col("species")).alias("species")
    ).agg(F.count(F.lit(1)).alias("n"))
    names = F.collect_list("species")
    return per_name.groupBy("group_key", "group_bin").agg(
        F.sum("n").alias("specimen_count"),
        F.count("species").alias("species_count"),
        F.array_join(F.array_sort(names), ", ").alias("group_species"),
    )


def group_caption(info: DataFrame, grade: str) -> DataFrame:
    """Adds ``caption``, the heading of a group."""
    # fixed values: the wording of the headings
    captions = {
        "A": ("Species: %s (>10 specimens, single BIN)", ["group_species"]),
        "B": ("Species: %s (3-10 specimens, single BIN)", ["group_species"]),
        "C": ("Species: %s - BIN: %s", ["group_species", "group_bin"]),
        "D": ("Species: %s (<3 specimens, single BIN)", ["group_species"]),
        "E": ("Shared BIN: %s (%d species)", ["group_bin", "species_count"]),
    }
    if grade not in captions:
        return info.withColumn("caption", F.lit(""))
    text, columns = captions[grade]
    return info.withColumn("caption", F.format_string(text, *[F.col(c) for c in columns]))


def grade_metrics(df: DataFrame, by=()) -> DataFrame:
    """Species, rows, mean score, countries; null counts as a species and as a country.

    ``by`` gives one row per value of those columns, e.g. ``["bags_grade"]``.
    """
    by = list(by)
    combos = df.groupBy(*by, "species", "country_ocean").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("quality_score").alias("score"),
        F.count("quality_score").alias("scored"),
    )
    return combos.groupBy(*by).agg(
        count_distinct_null_as_value("species").cast("long").alias("total_species"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_specimens"),
        F.coalesce(F.try_divide(F.sum("score"), F.sum("scored")), F.lit(0.0)).alias("avg_quality"),
        count_distinct_null_as_value("country_ocean").cast("long").alias("countries"),
    )
