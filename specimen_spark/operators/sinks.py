"""Exports. Each has a frame builder and a writer; writers take a directory.

Delimited and FASTA output is written by all tasks in parallel, one file per partition.
Sort before writing where a file order matters.
"""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specimen_spark import rules
from specimen_spark.functions.storage import directory_size
from specimen_spark.functions.text import is_blank, not_blank
from specimen_spark.operators.annotate import _flatten_lists, annot_merge_export
from specimen_spark.operators.filters import filter_annotated, filter_selected
from specimen_spark.schema import to_file_names


# --- delimited ------------------------------------------------------------------------------


def csv_frame(df: DataFrame) -> DataFrame:
    """All columns; lists joined by '; '."""
    return _flatten_lists(df)


def write_csv(df: DataFrame, path: str) -> None:
    (
        to_file_names(csv_frame(df)).write.mode("overwrite")
        .options(header=True, quoteAll=True, escape='"', nullValue="NA", emptyValue="",
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )


def tsv_frame(df: DataFrame) -> DataFrame:
    """Every value as unquoted text: tabs and line ends become spaces, booleans TRUE / FALSE,
    null NA."""
    out = {}
    for f in _flatten_lists(df).schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            c = F.upper(c.cast("string"))
        elif isinstance(f.dataType, T.StringType):
            c = F.translate(c, "\t\r\n", "   ")
        out[f.name] = F.coalesce(c.cast("string"), F.lit("NA"))
    return _flatten_lists(df).select(*[c.alias(n) for n, c in out.items()])


def write_tsv(df: DataFrame, path: str) -> None:
    (
        to_file_names(tsv_frame(df)).write.mode("overwrite")
        .options(header=True, sep="\t", quote="", emptyValue="",
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )


def tsv_all(df: DataFrame, annotations: DataFrame, widen=None) -> DataFrame:
    return annot_merge_export(df, annotations, widen)


def tsv_filtered(filtered: DataFrame, annotations: DataFrame, widen=None) -> DataFrame:
    """The rows of the current filters (``filter_rank``, ``filter_min_score``, ...)."""
    return annot_merge_export(filtered, annotations, widen)


def tsv_selected(df: DataFrame, annotations: DataFrame, widen=None) -> DataFrame:
    return annot_merge_export(filter_selected(df, annotations), annotations, widen)


def tsv_annotated(df: DataFrame, annotations: DataFrame, widen=None) -> DataFrame:
    return annot_merge_export(filter_annotated(df, annotations), annotations, widen)


def curation_report(df: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotated rows, report columns in order; absent ones are skipped."""
    rows = tsv_annotated(df, annotations)
    return rows.select(*[c for c in rules.REPORT_COLUMNS if c in rows.columns])


def export_columns(df: DataFrame, sequences: bool = False) -> DataFrame:
    """The fixed export projection; absent columns are skipped, ``nuc`` is optional, and
    ``inst`` serves where the frame has no ``institution``."""
    out = []
    for c in rules.EXPORT_COLUMNS:
        if c == "nuc" and not sequences:
            continue
        if c in df.columns:
            out.append(F.col(c))
        elif c == "institution" and "inst" in df.columns:
            out.append(F.col("inst").alias("institution"))
    return df.select(*out)


# --- FASTA ----------------------------------------------------------------------------------


def fasta(df: DataFrame) -> DataFrame:
    """(record): header ``>processid|identification`` and sequence in one value.

    Rows without a sequence are left out. One value per record keeps header and sequence
    together whatever the partitioning.
    """
    if "nuc" not in df.columns:
        return df.sparkSession.createDataFrame([], "record string")
    name = F.col("identification" if "identification" in df.columns else "species")
    name = F.when(is_blank(name), "Unknown").otherwise(name)
    return _records(df, [F.col("processid"), name])


def fasta_selected(df: DataFrame, annotations: DataFrame) -> DataFrame:
    return fasta(filter_selected(df, annotations))


def fasta_full(df: DataFrame) -> DataFrame:
    """Header ``>processid|species|bin_uri|country|collection_date_start``; null prints NA."""
    fields = ["processid", "species", "bin_uri", "country_ocean", "collection_date_start"]
    return _records(df, [F.col(c) for c in fields])


def _records(df: DataFrame, header) -> DataFrame:
    parts = [F.coalesce(c, F.lit("NA")) for c in header]
    line = F.concat(F.lit(">"), F.concat_ws("|", *parts))
    return df.filter(not_blank("nuc")).select(F.concat_ws("\n", line, "nuc").alias("record"))


def write_fasta(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").text(path)


# --- bundle and export log --------------------------------------------------------------------

def write_bundle(tables: dict, path: str, format: str = "parquet") -> DataFrame:
    """Write the given tables below one path; returns (table, path, records, total).

    Rows are counted while they are written, not by a second pass; ``total`` is their sum over the
    tables. The manifest is written last, so a bundle without one is incomplete.
    """
    present = {n: df for n, df in tables.items() if df is not None}
    if not present:
        raise ValueError("all tables of the bundle are absent")
    rows, spark = [], None
    for name, df in present.items():
        spark, seen = df.sparkSession, Observation()
        target = f"{path}/{name}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").format(
            format
        ).save(target)
        rows.append((name, target, int(seen.get["n"])))
    total = sum(n for _, _, n in rows)
    manifest = spark.createDataFrame([(*r, total) for r in rows], "`table` string, path string, records bigint, total bigint")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


EXPORT_LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("user_email", T.StringType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("export_type", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("format", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error_message", T.StringType()),
    ]
)


def export_log_entry(spark, entry: dict) -> DataFrame:
    """One audit row for an export; absent fields are null."""
    row = dict(entry)
    row.setdefault("level", "EXPORT")
    done = "completed" if row.get("success") else "failed"
    row.setdefault("message", f"Export {done}: {row.get('file_name')}")
    df = spark.createDataFrame(
        [tuple(row.get(f.name) for f in EXPORT_LOG_SCHEMA)], EXPORT_LOG_SCHEMA
    )
    return df.withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp()))


def append_export_log(spark, path: str, entry: dict) -> None:
    """One more row in the folder of its day."""
    row = export_log_entry(spark, entry).withColumn("day", F.to_date("timestamp"))
    row.coalesce(1).write.mode("append").partitionBy("day").parquet(path)


def read_export_log(spark, path: str) -> DataFrame:
    """All rows with their ``day``; a date range on it reads the folders of those days alone."""
    declared = T.StructType([*EXPORT_LOG_SCHEMA.fields, T.StructField("day", T.DateType())])
    return spark.read.schema(declared).parquet(path)


def logged_export(spark, audit_path: str, write, frame: DataFrame, path: str, **entry) -> bool:
    """Run a writer and append one audit row, also when it fails."""
    seen = Observation()
    watched = frame.observe(seen, F.count(F.lit(1)).alias("n"))
    try:
        write(watched, path)
    except Exception as error:  # the failure is recorded, as a failed export
        append_export_log(
            spark, audit_path,
            {**entry, "record_count": 0, "file_size": 0, "success": False,
             "error_message": str(error).splitlines()[0]},
        )
        return False
    append_export_log(
        spark, audit_path,
        {**entry, "record_count": int(seen.get["n"]), "file_size": directory_size(spark, path),
         "success": True},
    )
    return True
