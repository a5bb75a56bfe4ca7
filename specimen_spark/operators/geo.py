"""Geography filter, size gate, search metrics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimen_spark import rules
from specimen_spark.functions.text import not_blank


def geo_countries(dim: DataFrame, continents=(), countries=()) -> DataFrame:
    """Countries of the chosen continents together with an explicit list, distinct."""
    spark = dim.sparkSession
    chosen = dim.filter(F.col("continent").isin(list(continents))).select("country")
    if isinstance(countries, DataFrame):
        explicit = countries.select("country")
    else:
        explicit = spark.createDataFrame([(c,) for c in countries], "country string")
    return chosen.union(explicit).distinct()


def continents_of_countries(dim: DataFrame, countries: DataFrame) -> DataFrame:
    """Continents that contain any listed country."""
    return dim.join(countries.select("country"), "country", "left_semi").select(
        "continent"
    ).distinct()


def filter_geo(df: DataFrame, countries: DataFrame | None) -> DataFrame:
    """Rows whose country is listed, exact and untrimmed; null countries are dropped.

    None means no filter. An empty frame is tested for at run time and also means no filter.
    """
    if countries is None:
        return df
    wanted = countries.select(F.col("country").alias("_country")).distinct()
    if wanted.isEmpty():
        return df
    return df.join(wanted, F.col("country_ocean") == F.col("_country"), "left_semi")


def geo_report(df: DataFrame, countries: DataFrame) -> DataFrame:
    """(records_before, records_after, records_removed): counted per country, then joined."""
    per_country = df.groupBy("country_ocean").agg(F.count(F.lit(1)).alias("n"))
    wanted = countries.select(F.col("country").alias("_country")).distinct().withColumn(
        "_in", F.lit(True)
    )
    counted = per_country.join(
        wanted, per_country.country_ocean == wanted._country, "left"
    ).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records_before"),
        F.coalesce(F.sum(F.when(F.col("_in"), F.col("n"))), F.lit(0)).alias("records_after"),
    )
    return counted.withColumn("records_removed", F.col("records_before") - F.col("records_after"))


def size_gate(df: DataFrame, max_records=rules.MAX_RECORDS, max_bins=rules.MAX_BINS) -> DataFrame:
    """(records, bins, over_limit): strictly above either limit. The caller decides."""
    per_bin = df.groupBy("bin_uri").agg(F.count(F.lit(1)).alias("n"))
    return per_bin.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.count_if(not_blank("bin_uri")).alias("bins"),
    ).withColumn(
        "over_limit", (F.col("records") > max_records) | (F.col("bins") > max_bins)
    )


def search_metrics(df: DataFrame) -> DataFrame:
    """Records and distinct non-null species, BINs and countries; zeros when empty.

    The distinct counts run on the combinations, not on the rows.
    """
    combos = df.groupBy("species", "bin_uri", "country_ocean").agg(F.count(F.lit(1)).alias("n"))
    return combos.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.count_distinct("species").alias("unique_species"),
        F.count_distinct("bin_uri").alias("unique_bins"),
        F.count_distinct("country_ocean").alias("countries"),
    )
