"""Import cleaning."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimen_spark.functions.text import blank_to_null, import_name
from specimen_spark.operators.merge import dedupe_processid

# Fixed value: the tag of the record source.
SOURCE_TAG = "BOLD"


def _set(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, value) if name in df.columns else df


def clean_species(df: DataFrame) -> DataFrame:
    return _set(df, "species", import_name("species"))


def clean_bin(df: DataFrame) -> DataFrame:
    return _set(df, "bin_uri", blank_to_null("bin_uri"))


def clean_country(df: DataFrame) -> DataFrame:
    return _set(df, "country_ocean", blank_to_null("country_ocean"))


def add_provenance(df: DataFrame, source: str = SOURCE_TAG) -> DataFrame:
    return df.withColumns({"data_source": F.lit(source), "import_date": F.current_timestamp()})


def clean_rows(df: DataFrame) -> DataFrame:
    """Names, BINs and countries cleaned; row-wise, the same when done twice."""
    return clean_country(clean_bin(clean_species(df)))


def process_import(df: DataFrame, tie=None, provenance: bool = True, widen=None) -> DataFrame:
    """Clean names, BINs and countries, add provenance, one row per ``processid``.

    Cleaning is row-wise, so it runs after the deduplication and touches fewer rows.
    ``widen``, a row-wise function, gives the columns of compact rows; only these are shuffled then.
    Sort by ``processid`` at the sink.
    """
    kept = dedupe_processid(df, tie)
    out = clean_rows(widen(kept) if widen else kept)
    return add_provenance(out) if provenance else out
