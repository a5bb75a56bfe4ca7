"""User lists (taxa, codes, countries) and the geography dimension as DataFrames."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark import rules
from specimen_spark.functions.text import trimws


def read_lines(spark: SparkSession, path) -> DataFrame:
    """(line_no, text): ``line_no`` grows with the position in the file."""
    return spark.read.text(path).select(
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("text")
    )


def taxon_groups(lines: DataFrame) -> DataFrame:
    """(group_id, label, pos, name): one group per line, names split at commas.

    Names are trimmed, blank names and empty groups dropped. ``pos`` 0 is the valid name,
    the rest are synonyms.
    """
    names = F.filter(
        F.transform(F.split("text", ","), lambda n: trimws(n)), lambda n: n != ""
    )
    return (
        lines.select(F.col("line_no").alias("group_id"), names.alias("names"))
        .filter(F.size("names") > 0)
        .select(
            "group_id",
            F.array_join("names", ", ").alias("label"),
            F.posexplode("names").alias("pos", "name"),
        )
    )


def read_taxon_groups(spark: SparkSession, path) -> DataFrame:
    return taxon_groups(read_lines(spark, path))


def search_names(groups: DataFrame) -> DataFrame:
    """All distinct names of the groups: the flat search list."""
    return groups.select("name").distinct()


def code_list(lines: DataFrame, dedupe: bool = False) -> DataFrame:
    """(code): newline-separated entries, trimmed, blanks dropped; countries also distinct."""
    codes = (
        lines.select(F.explode(F.split("text", "\n")).alias("code"))
        .select(trimws("code").alias("code"))
        .filter("code <> ''")
    )
    return codes.distinct() if dedupe else codes


def continents(spark: SparkSession, mapping=None) -> DataFrame:
    """(continent, country): a fixed list of fewer than 200 rows."""
    mapping = rules.CONTINENTS if mapping is None else mapping
    rows = [(continent, country) for continent, names in mapping.items() for country in names]
    return spark.createDataFrame(rows, "continent string, country string")
