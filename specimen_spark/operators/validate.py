"""Validation flags and checks. Checks return a one-row frame (valid, message)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimen_spark import rules, schema
from specimen_spark.functions.text import has_valid_name, is_blank, matches, not_blank, trimws


def validate_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "valid_species": has_valid_name("species"),
            "species_id": not_blank("species"),
            "valid_bin": not_blank("bin_uri"),
        }
    )


def validate_counts(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("valid_species").alias("valid_species"),
        F.count_if("species_id").alias("species_id"),
        F.count_if("valid_bin").alias("valid_bin"),
    )


def filter_bin_valid(flagged: DataFrame) -> DataFrame:
    return flagged.filter("valid_bin")


def filter_species_id(flagged: DataFrame) -> DataFrame:
    return flagged.filter("species_id")


def _verdict(df: DataFrame, valid: bool, message: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(valid, message)], "valid boolean, message string")


def _missing_message(df: DataFrame) -> str | None:
    missing = schema.missing_columns(df)
    return "absent columns: " + ", ".join(missing) if missing else None


def check_required(df: DataFrame) -> DataFrame:
    """Rows present, required columns present, at least one non-null BIN."""
    message = _missing_message(df)
    if message:
        return _verdict(df, False, message)
    counted = df.agg(F.count(F.lit(1)).alias("n"), F.count("bin_uri").alias("bins"))
    return counted.select(
        ((F.col("n") > 0) & (F.col("bins") > 0)).alias("valid"),
        F.when(F.col("n") == 0, "the table has no rows")
        .when(F.col("bins") == 0, "no row has a BIN")
        .otherwise("")
        .alias("message"),
    )


def check_results(df: DataFrame) -> DataFrame:
    """Rows present, required columns present, no null or blank ``processid``."""
    message = _missing_message(df)
    if message:
        return _verdict(df, False, message)
    counted = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_blank("processid")).alias("blank")
    )
    return counted.select(
        ((F.col("n") > 0) & (F.col("blank") == 0)).alias("valid"),
        F.when(F.col("n") == 0, "nothing was retrieved")
        .when(F.col("blank") > 0, F.format_string("%d rows have no processid", F.col("blank")))
        .otherwise("")
        .alias("message"),
    )


def validate_search_terms(terms: DataFrame, countries: DataFrame) -> DataFrame:
    """(kind, term) rows -> (kind, term, valid, message).

    Kinds: taxon, dataset, project, country. Blank terms are dropped. Too-long names and
    unknown countries are warnings: the term stays valid.
    """
    known = countries.select(F.col("country").alias("_country")).distinct()
    t = (
        terms.select("kind", trimws("term").alias("term"))
        .filter("term <> ''")
        .join(known.withColumn("_known", F.lit(True)),
              (F.col("kind") == "country") & (F.col("term") == F.col("_country")), "left")
    )
    taxon, kind = F.col("kind") == "taxon", F.col("kind")
    bad = (
        F.when(taxon & matches("term", rules.TAXON_BAD_CHARS),
               "a taxon name may hold letters, digits, spaces, hyphens, underscores and periods only")
        .when((kind == "dataset") & ~matches("term", rules.DATASET_CODE),
              "a dataset code starts with DS-")
        .when((kind == "project") & matches("term", rules.PROJECT_BAD_CHARS),
              "a project code may hold letters, digits, hyphens and underscores only")
    )
    warning = (
        F.when(taxon & (F.length("term") > rules.MAX_TAXON_LENGTH),
               "check this taxon name: it is long")
        .when((kind == "country") & F.col("_known").isNull(),
              F.concat(F.lit("unknown country: "), F.col("term")))
    )
    return t.select(
        "kind", "term", bad.isNull().alias("valid"), F.concat_ws("; ", bad, warning).alias("message")
    )


def has_search_terms(taxa=None, datasets=None, projects=None, countries=None) -> bool:
    """At least one kind of input is needed for a search."""
    return any(x is not None for x in (taxa, datasets, projects, countries))
