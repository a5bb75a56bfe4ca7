"""Runtime settings the plans of this package profit from."""

from pyspark.sql import SparkSession

SETTINGS = {
    # Wide projections (16 criteria with regexes) compile to methods above HotSpot's 8000
    # byte limit for the JIT compiler; such stages run faster outside whole-stage codegen,
    # where Spark splits the expressions into small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Skewed joins are split and small shuffle partitions merged at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A side whose shuffled parts are small is hashed, so the other side is not sorted (and spilled).
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Tasks that sort what they read before a shuffle hold this much of a table.
    "spark.sql.files.maxPartitionBytes": "16m",
}
#: Input per shuffle partition before small ones are merged, so that none is sorted on disk.
_INPUT = 8 << 20
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def tune(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    """Settings for a query over an input of this size; the shuffle partitions asked for are the least."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(_INITIAL, str(max(asked, input_bytes // _INPUT)))
    return spark
