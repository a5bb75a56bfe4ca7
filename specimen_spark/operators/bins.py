"""BIN content and taxonomic concordance."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimen_spark import rules
from specimen_spark.functions.text import matches, not_blank
from specimen_spark.schema import column_or_null


def _combinations(df: DataFrame, with_country: bool) -> DataFrame:
    """Rows with a BIN, counted per combination of the taxonomy columns.

    A hot BIN is spread over its combinations and combined on the map side here; the
    per-BIN step after it only sees distinct combinations.
    """
    columns = [F.col("bin_uri")] + [
        column_or_null(df, c).alias(c) for c in ("species", "genus", "family", "order")
    ]
    if with_country:
        columns.append(column_or_null(df, "country_ocean").alias("country_ocean"))
    rows = df.filter(not_blank("bin_uri")).select(*columns)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def _several(c) -> Column:
    """More than one distinct non-null value, without building a set."""
    return F.coalesce(F.min(c) != F.max(c), F.lit(False))


def _filled(name: str):
    return F.when(not_blank(name), F.col(name))


def _taxonomy_aggregates() -> list:
    species = F.col("species")
    valid = F.when(
        not_blank("species") & ~matches("species", rules.CONCORDANCE_NAME_REJECT), species
    )
    # A cf. name never conflicts; an aff. name conflicts unless the valid name follows at once. Texts that
    # begin with one name lie next to each other, so the first and the last of what follows tell for
    # all; only names that hold aff. more than once, where any may do, are kept.
    aff_only = F.when(matches("species", r"aff\.") & ~matches("species", r"cf\."), species)
    once = F.when(~matches("species", r"aff\..*aff\."), F.substring_index(aff_only, "aff.", -1))
    often = F.when(matches("species", r"aff\..*aff\."), aff_only)
    return [
        _several(valid).alias("_several_valid"),
        F.max(valid).alias("_valid"),
        F.min(once).alias("_aff_first"),
        F.max(once).alias("_aff_last"),
        F.collect_set(often).alias("_aff_often"),
        _several(_filled("genus")).alias("_several_genus"),
        F.coalesce(F.max(not_blank("genus")), F.lit(False)).alias("_has_genus"),
        _several(_filled("family")).alias("_several_family"),
        F.coalesce(F.max(not_blank("family")), F.lit(False)).alias("_has_family"),
        _several(_filled("order")).alias("_several_order"),
    ]


def _discordant():
    """The rule on the aggregates. The valid name is compared as plain text, not as a regex."""
    valid = F.col("_valid")
    conflicting = F.coalesce(~(F.col("_aff_first").startswith(valid) & F.col("_aff_last").startswith(valid)), F.lit(False)) | F.exists(
        "_aff_often", lambda name: ~name.contains(F.concat(F.lit("aff."), valid))
    )
    return (
        F.col("_several_valid")
        | (F.col("_valid").isNotNull() & conflicting)
        | F.col("_several_genus")
        | (~F.col("_has_genus") & F.col("_several_family"))
        | (~F.col("_has_genus") & ~F.col("_has_family") & F.col("_several_order"))
    )


def _concordance():
    return F.when(_discordant(), "Discordant").otherwise("Concordant")


def bin_concordance(df: DataFrame) -> DataFrame:
    """(bin_uri, concordance)."""
    per_bin = _combinations(df, False).groupBy("bin_uri").agg(*_taxonomy_aggregates())
    return per_bin.select("bin_uri", _concordance().alias("concordance"))


def bin_content(df: DataFrame) -> DataFrame:
    """One row per BIN. ``bin_coverage`` is the share of the rows passed in."""
    listed = F.when(
        not_blank("species") & ~matches("species", rules.SPECIES_LIST_REJECT), F.col("species")
    )
    per_bin = (
        _combinations(df, True)
        .groupBy("bin_uri")
        .agg(
            F.sum("n").alias("total_records"),
            F.array_sort(F.collect_set(listed)).alias("_species"),
            F.array_sort(F.collect_set("country_ocean")).alias("_countries"),
            *_taxonomy_aggregates(),
        )
    )
    all_rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return per_bin.select(
        "bin_uri",
        "total_records",
        F.size("_species").cast("long").alias("unique_species"),
        F.array_join("_species", "; ").alias("species_list"),
        F.array_join("_countries", "; ").alias("countries"),
        _concordance().alias("concordance"),
        (F.col("total_records") / all_rows).alias("bin_coverage"),
        F.when(_discordant(), 0.0).otherwise(1.0).alias("concordant_bins"),
    )


def bin_summary(content: DataFrame) -> DataFrame:
    return content.agg(
        F.count(F.lit(1)).alias("total_bins"),
        F.count_if(F.col("concordance") == "Concordant").alias("concordant_bins"),
        F.count_if(F.col("concordance") == "Discordant").alias("discordant_bins"),
        F.count_if(F.col("unique_species") > 1).alias("shared_bins"),
    )
