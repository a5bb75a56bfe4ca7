"""Specimen schema: declared columns, name mapping, conforming a frame."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ["processid", "species", "bin_uri"]

# Column names of a specimen dump, grouped by subject.
_TEXT_COLUMNS = [
    "processid", "record_id", "insdc_acs", "sampleid", "specimenid", "taxid", "bin_uri",
    "collection_code", "collection_date_start", "collection_date_end", "collection_time",
    "collection_event_id", "collection_notes",
    "country_ocean", "province_state", "region", "site", "coord", "coord_source",
    "coord_accuracy", "elev", "elev_accuracy", "depth", "depth_accuracy",
    "kingdom", "phylum", "class", "order", "family", "tribe", "genus", "species",
    "subspecies", "identification", "identified_by", "identification_method",
    "identification_rank", "taxonomy_notes",
    "voucher_type", "sex", "life_stage", "reproduction", "habitat", "associated_taxa",
    "associated_specimens", "tissue_type", "notes",
    "inst", "funding_src", "museumid",
    "marker_code", "nuc", "nuc_basecount", "sequence_upload_date", "sequence_run_site",
    "bin_created_date", "biome", "bold_recordset_code_arr", "collectors", "country_iso",
    "data_source", "ecoregion", "fieldid", "geoid", "processid_minted_date", "realm",
    "sampling_protocol", "sector", "short_note", "site_code", "species_reference",
    "specimen_linkout", "subfamily",
]
_TYPED_COLUMNS = [
    ("has_image", T.BooleanType()),
    ("import_date", T.TimestampType()),
    ("quality_score", T.DoubleType()),
    ("criteria_met", T.StringType()),
    ("rank", T.IntegerType()),
    ("valid_species", T.BooleanType()),
    ("species_id", T.BooleanType()),
    ("valid_bin", T.BooleanType()),
    ("selected", T.BooleanType()),
    ("flag", T.StringType()),
    ("updated_id", T.StringType()),
    ("curator_notes", T.StringType()),
]

# A dot means struct access in Spark, so dotted names exist only in files.
FILE_NAMES = {"country_ocean": "country.ocean", "province_state": "province.state"}
TABLE_NAMES = {v: k for k, v in FILE_NAMES.items()}

SPECIMEN_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT_COLUMNS]
    + [T.StructField(c, t) for c, t in _TYPED_COLUMNS]
)
# What an external dump holds: the text columns and the image flag.
DUMP_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT_COLUMNS]
    + [T.StructField("has_image", T.BooleanType())]
)


def to_table_names(df: DataFrame) -> DataFrame:
    """Dotted file names -> table names."""
    return df.toDF(*[TABLE_NAMES.get(c, c) for c in df.columns])


def to_file_names(df: DataFrame) -> DataFrame:
    """Table names -> dotted file names; only for sinks."""
    return df.toDF(*[FILE_NAMES.get(c, c) for c in df.columns])


def missing_columns(df: DataFrame, required=REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def conform(df: DataFrame, columns=None, required=("processid",)) -> DataFrame:
    """Add absent optional columns as typed nulls; raise when a required one is absent.

    ``columns`` limits the additions to the named ones (default: the whole schema).
    Narrow frames stay narrow that way.
    """
    absent = missing_columns(df, required)
    if absent:
        raise ValueError("absent columns: " + ", ".join(absent))
    wanted = SPECIMEN_SCHEMA.fieldNames() if columns is None else columns
    nulls = {
        c: F.lit(None).cast(SPECIMEN_SCHEMA[c].dataType) for c in wanted if c not in df.columns
    }
    return df.withColumns(nulls) if nulls else df


def column_or_null(df: DataFrame, name: str, dtype=None):
    """The column, or a typed null when the frame lacks it."""
    if name in df.columns:
        return F.col(name)
    if dtype is None:
        dtype = SPECIMEN_SCHEMA[name].dataType if name in SPECIMEN_SCHEMA.fieldNames() else T.StringType()
    return F.lit(None).cast(dtype)
