"""Helpers the operators of this folder share: inputs, stages, Arrow in tasks, numbering."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specimen_spark.functions.storage import delete, materialize

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepared(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did.

    Where the package is installed on the workers, or sent with ``--py-files``, this changes
    nothing.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *[p for p in known if p]])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting to delete an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, then let its shuffle files go.

    So the disk in use stays near that of the largest stage, not of all stages.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return materialize(df, name)
    finally:
        conf.set(_CLEANUP, before)


def release(*frames: DataFrame) -> None:
    """Delete tables that ``staged`` wrote, once a table that was made from them is written."""
    for df in frames:
        for folder in {os.path.dirname(file) for file in df.inputFiles()}:
            delete(df.sparkSession, folder)


#: Rows of a written table up to this go to all tasks in a join; more meet the other side in a shuffle.
MAX_BROADCAST = 2_000_000


def few(written: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """A written table for a join with texts: up to ``most`` rows go to all tasks, so that no text moves."""
    return F.broadcast(written) if written.count() <= most else written


def without(docs: DataFrame, mark: str, bad: DataFrame) -> DataFrame:
    """The rows whose ``mark``, an expression over ``row.<column>``, is not in the one column of ``bad``, a written table.

    All columns pass, whatever their names; a null mark matches a null.
    """
    key = bad.columns[0]
    rows = docs.select(F.struct("*").alias("row")).select("row", F.expr(mark).alias("mark"))
    gone = few(bad.select(F.col(key).alias("gone")))
    return rows.join(gone, F.col("mark").eqNullSafe(F.col("gone")), "left_anti").select("row.*")


def row_number_gapless(placed: DataFrame, group: list, order: list, out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps; ``placed`` must be a written table.

    Its column ``pid`` says which task wrote a row. Rows are numbered inside (group, pid),
    and each pid begins where the earlier ones end, so no task holds a whole group. Only
    one count per (group, pid) meets in the running sum.
    """
    number = F.row_number().over(W.partitionBy(*group, "pid").orderBy(*order))
    begin = W.partitionBy(*group).orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy(*group, "pid").agg(F.count(F.lit(1)).alias("_n")).select(
        *group, "pid", F.coalesce(F.sum("_n").over(begin), F.lit(0)).alias("_begin")
    )
    return (
        placed.withColumn("_in", number)
        .join(starts, [*group, "pid"])
        .withColumn(out, (F.col("_begin") + F.col("_in") - 1).cast("long"))
        .drop("_begin", "_in", "pid")
    )


def batches_of(batch: pa.RecordBatch, column: str, most_bytes: int):
    """Slices of a batch whose ``column`` holds about ``most_bytes``; a long text is alone.

    Yields (first row, last row + 1). Bounds what a task holds at once.
    """
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(
        zero_copy_only=False
    )
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if i > at and held + size > most_bytes:
            yield at, i
            at, held = i, 0
        held += int(size)
    if at < len(sizes):
        yield at, len(sizes)
