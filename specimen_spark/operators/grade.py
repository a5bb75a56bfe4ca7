"""Species grades A-E and representative selection."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimen_spark import rules
from specimen_spark.functions.text import is_binomial, is_blank, not_blank
from specimen_spark.functions.windows import first_per_key


def is_species_level(df: DataFrame) -> Column:
    """Two-word name and, where the frame has the column, a species or subspecies rank."""
    named = is_binomial("species")
    if "identification_rank" not in df.columns:
        return named
    return named & has_species_rank()


def has_species_rank() -> Column:
    return F.coalesce(F.col("identification_rank").isin(rules.SPECIES_RANKS), F.lit(False))


def species_level(df: DataFrame) -> DataFrame:
    return df.filter(is_species_level(df))


def _species_bins(df: DataFrame) -> DataFrame:
    """(species, bin_uri, n) of species-level rows; no BIN is the empty string.

    The only pass over the rows. It is combined on the map side, and a hot species or BIN
    spreads over its partners; everything after works on these pairs. The BIN is never
    null, so no null filter is pushed into one branch and both branches share the shuffle.
    """
    return (
        species_level(df)
        .select("species", F.coalesce("bin_uri", F.lit("")).alias("bin_uri"))
        .groupBy("species", "bin_uri")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _bin_sharing(pairs: DataFrame) -> DataFrame:
    # counting on `n` keeps the column in this branch too, so the shuffle of the pairs is
    # the same in both branches and runs once
    counted = pairs.groupBy("bin_uri").agg(F.count_if(F.col("n") > 0).alias("species_count"))
    return counted.withColumn(
        "is_shared", (F.col("species_count") > 1) & (F.col("bin_uri") != "")
    )


def shared_bins(df: DataFrame) -> DataFrame:
    """(bin_uri, species_count, is_shared) over species-level rows."""
    return _bin_sharing(_species_bins(df)).filter("bin_uri <> ''")


def grade_rule(specimen_count: Column, bin_count: Column, shared: Column) -> Column:
    """E shared or bad counts; C several BINs; D few rows; A many; else B - in this order."""
    shared = F.coalesce(shared, F.lit(False))
    bad = (
        specimen_count.isNull() | bin_count.isNull() | (specimen_count < 0) | (bin_count < 0)
    )
    return (
        F.when(bad | shared, "E")
        .when(bin_count > 1, "C")
        .when(specimen_count < rules.GRADE_D_BELOW, "D")
        .when(specimen_count >= rules.GRADE_A_MIN, "A")
        .otherwise("B")
    )


def bags_grades(df: DataFrame) -> DataFrame:
    """One row per species: grade, rows, distinct BINs, any BIN shared."""
    pairs = _species_bins(df)
    shared = _bin_sharing(pairs).select("bin_uri", "is_shared")
    per_species = (
        pairs.join(shared, "bin_uri")
        .groupBy("species")
        .agg(
            F.sum("n").alias("specimen_count"),
            F.count_if(F.col("bin_uri") != "").alias("bin_count"),
            F.max("is_shared").alias("shared_bins"),
        )
    )
    grade = grade_rule(F.col("specimen_count"), F.col("bin_count"), F.col("shared_bins"))
    return per_species.select(
        "species", grade.alias("bags_grade"), "specimen_count", "bin_count", "shared_bins"
    )


GRADE_COLUMNS = ["species", "bags_grade", "specimen_count", "bin_count", "shared_bins"]


def check_grades(grades: DataFrame) -> DataFrame:
    """(valid, message): columns present, grades in A-E, no negative counts, not empty."""
    missing = [c for c in GRADE_COLUMNS if c not in grades.columns]
    has = grades.columns
    problems = [F.when(F.lit(bool(missing)), "absent columns: " + ", ".join(missing))]
    aggs = [F.count(F.lit(1)).alias("n")]
    if "bags_grade" in has:
        outside = ~F.coalesce(F.col("bags_grade").isin(rules.GRADES), F.lit(False))
        aggs.append(F.count_if(outside).alias("bad_grade"))
        problems.append(F.when(F.col("bad_grade") > 0, "a grade is not one of A to E"))
    for name, label in (("specimen_count", "specimen"), ("bin_count", "BIN")):
        if name in has:
            aggs.append(F.count_if(F.col(name) < 0).alias("bad_" + name))
            problems.append(
                F.when(F.col("bad_" + name) > 0, f"a {label} count is below 0")
            )
    message = F.when(F.col("n") == 0, "there are no grades").otherwise(
        F.concat_ws("; ", *problems)
    )
    return grades.agg(*aggs).select((message == "").alias("valid"), message.alias("message"))


def grade_counts(grades: DataFrame) -> DataFrame:
    return grades.groupBy("bags_grade").agg(F.count(F.lit(1)).alias("species"))


# --- representatives -----------------------------------------------------------------------


def auto_select(df: DataFrame) -> DataFrame:
    """The best record per BIN and country ('Unknown' where blank): top score, ties by key."""
    country = F.when(is_blank("country_ocean"), "Unknown").otherwise(F.col("country_ocean"))
    candidates = df.filter(not_blank("bin_uri") & not_blank("species")).select(
        "processid", "species", "quality_score", "bin_uri", country.alias("country_group")
    )
    best = first_per_key(
        candidates,
        ["bin_uri", "country_group"],
        [F.col("quality_score").desc_nulls_last(), F.col("processid")],
    )
    return best.select(
        "processid", "species", "quality_score", F.lit("auto").alias("user"),
        F.lit(True).alias("selected"), F.lit(True).alias("auto_selected"),
    )


def auto_select_if_empty(df: DataFrame, selections: DataFrame | None) -> DataFrame:
    """Keep the existing selections when there are any; else select. One probe action."""
    if selections is not None and not selections.isEmpty():
        return selections
    return auto_select(df)


def representative_per_species(picks: DataFrame, tie: str = "processid") -> DataFrame:
    """A later pick of a species replaces the earlier one (``ts``; ties by the tie column)."""
    return first_per_key(
        picks, "species", [F.col("ts").desc_nulls_last(), F.col(tie).desc_nulls_last()]
    )
