"""Where intermediate tables go, and cutting lineage."""

import contextlib
import hashlib
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Where it is unset and everything runs in one local process, a temporary folder is made and
    set. On a cluster each machine would have its own, so there this is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several branches read to the shared folder and read it back.

    A table cuts the lineage like a checkpoint, survives lost executors, and unlike one
    stays columnar: each branch reads only its columns.
    """
    path = new_path(df.sparkSession, name)
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's setting to delete an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_released(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends, so disk in use stays near the largest stage's."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def identity(spark: SparkSession, path: str) -> str:
    """Names the state of a file or folder: path, length and time of each file."""
    fs, target = file_system(spark, path)
    status = fs.getFileStatus(target)
    found = fs.listStatus(target) if status.isDirectory() else [status]
    return "\n".join(sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in found))


def file_system(spark: SparkSession, path: str):
    """The file system that holds a path, and the path for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, none if it is missing."""
    fs, target = file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return bool(fs.exists(target))


def directory_size(spark: SparkSession, path: str) -> int:
    """Bytes below a path, from the file system's own summary."""
    fs, target = file_system(spark, path)
    return int(fs.getContentSummary(target).getLength())


#: Rows of a written table's file, so that a task that reads one can sort it in memory.
FILE_ROWS = 500_000
_LOCK = threading.RLock()  # a build may ask for another written table


def written_once(spark: SparkSession, name: str, source: str, build) -> DataFrame:
    """A derived table, written on first use and read after that.

    Kept below the shared folder per application and source, so every query of an
    application scans the same columnar table instead of deriving it again. ``source`` names
    the state of the input (see ``identity``): changed tables are derived anew. ``build`` gives
    the frame. Only a completely written table (with its success marker) is reused.
    """
    mark = hashlib.sha256(source.encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{mark}"
    with _LOCK:
        if not _complete(spark, path):
            frame = build()
            with shuffles_released(spark):
                frame.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
            _WRITTEN_SCHEMAS.pop(path, None)
        if path not in _WRITTEN_SCHEMAS:
            _WRITTEN_SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_WRITTEN_SCHEMAS[path]).parquet(path)


_WRITTEN_SCHEMAS = {}


def _complete(spark: SparkSession, path: str) -> bool:
    return exists(spark, path + "/_SUCCESS")
