"""Specimen dumps, image tables and annotation tables as DataFrames."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specimen_spark import schema
from specimen_spark.functions.storage import file_system


def read_specimens(
    spark: SparkSession, path, format: str = "parquet", columns=None, multiline: bool = False
) -> DataFrame:
    """Read a specimen dump: tsv, csv, json, or any format Spark reads by name.

    No schema inference. Delimited dumps are read as text by their header and cast to the
    declared types; ``NA`` is null there and an empty field stays an empty string. Files may
    order their columns differently. ``multiline``: quoted csv fields may hold line ends; a
    file is then read by one task.
    """
    fmt = format.lower()
    if fmt in ("tsv", "csv"):
        reader = spark.read.options(**_DELIMITED[fmt], multiLine=multiline)
        groups = _by_header(spark, path).values()
        if not groups:
            raise ValueError("the dump has no header line")
        parts = [schema.to_table_names(reader.csv(files)) for files in groups]
        df = _typed(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))
    elif fmt == "json":
        declared = T.StructType(
            [
                T.StructField(schema.FILE_NAMES.get(f.name, f.name), f.dataType)
                for f in schema.DUMP_SCHEMA
            ]
        )
        df = schema.to_table_names(spark.read.schema(declared).json(path))
    else:
        df = schema.to_table_names(spark.read.format(fmt).load(path))
    df = schema.conform(df, columns=columns or [])
    return df.select(*columns) if columns else df


_DELIMITED = {
    "tsv": {
        "header": True, "sep": "\t", "quote": "",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    },
    "csv": {
        "header": True, "escape": '"',
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    },
}


def _by_header(spark: SparkSession, path) -> dict[str, list[str]]:
    """Files by their first line. Spark takes one header for all files of a read, by position."""
    found: dict[str, list[str]] = {}
    io, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = io.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    for p in [path] if isinstance(path, str) else path:
        fs, target = file_system(spark, p)
        waiting = list(fs.globStatus(target) or [])
        if not waiting:
            raise FileNotFoundError(p)
        while waiting:
            status = waiting.pop()
            at = status.getPath()
            if status.isDirectory():
                waiting += [s for s in fs.listStatus(at) if s.getPath().getName()[:1] not in ("_", ".")]
                continue
            codec, stream = codecs.getCodec(at), fs.open(at)
            if codec is not None:
                stream = codec.createInputStream(stream)
            lines = io.java.io.BufferedReader(io.java.io.InputStreamReader(stream, "UTF-8"))
            header = lines.readLine()
            lines.close()
            if header is not None:
                found.setdefault(header, []).append(at.toString())
    return {h: sorted(files) for h, files in found.items()}


def _typed(df: DataFrame) -> DataFrame:
    types = {f.name: f.dataType for f in schema.SPECIMEN_SCHEMA}
    out = []
    for c in df.columns:
        dtype = types.get(c, T.StringType())
        filled = F.coalesce(F.col(c), F.lit(""))
        value = F.when(filled != "NA", filled)
        if not isinstance(dtype, T.StringType):
            value = value.try_cast(dtype)
        out.append(value.alias(c))
    return df.select(*out)


IMAGE_SCHEMA = T.StructType(
    [T.StructField("processid", T.StringType()), T.StructField("objectid", T.StringType())]
)


def read_images(spark: SparkSession, path, format: str = "json") -> DataFrame:
    """(processid, objectid) rows; JSON may hold one array per file."""
    reader = spark.read.schema(IMAGE_SCHEMA)
    if format == "json":
        return reader.option("multiLine", True).json(path)
    return spark.read.format(format).load(path).select("processid", "objectid")


def with_images(specimens: DataFrame, images: DataFrame) -> DataFrame:
    """``has_image`` = the specimen has at least one row in the image table.

    Only the distinct keys travel, so a specimen with very many images costs one row per
    map task. An existing ``has_image`` is replaced.
    """
    found = (
        images.filter(F.col("processid").isNotNull() & (F.col("processid") != ""))
        .select("processid")
        .distinct()
        .withColumn("_found", F.lit(True))
    )
    return (
        specimens.drop("has_image")
        .join(found, "processid", "left")
        .withColumn("has_image", F.coalesce("_found", F.lit(False)))
        .drop("_found")
    )


def with_images_if_needed(specimens: DataFrame, images: DataFrame) -> DataFrame:
    """Keep ``has_image`` when it is present, boolean and null-free; else look all rows up.

    The null test is one action; call ``with_images`` directly to stay lazy.
    """
    if "has_image" in specimens.columns and isinstance(
        specimens.schema["has_image"].dataType, T.BooleanType
    ):
        if specimens.filter(F.col("has_image").isNull()).isEmpty():
            return specimens
    return with_images(specimens, images)


def read_annotations(spark: SparkSession, path) -> DataFrame:
    """Annotation table from JSON lines ``{processid, kind, value}``.

    ``value`` is an object or a bare scalar; it is read as its JSON text and brought to the
    flat form (processid, kind, value, user, ts).
    """
    from specimen_spark.operators.annotate import normalize_annotations

    declared = T.StructType(
        [
            T.StructField("processid", T.StringType()),
            T.StructField("kind", T.StringType()),
            T.StructField("value", T.StringType()),
        ]
    )
    return normalize_annotations(spark.read.schema(declared).json(path))
