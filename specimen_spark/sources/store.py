"""A stored universe: records in buckets by BIN, and an index from codes and names to buckets.

Records of a BIN lie in one bucket (those without a BIN by their processid), so BIN membership is a join that
moves the seed's BINs only. The index says which buckets hold a recordset code, a name at any rank
or, for the few processids whose records lie in several, a processid: a short request reads the files of
those buckets. The index is range-partitioned and sorted by code, so that a lookup reads few row groups.
"""

import hashlib
import re
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specimen_spark.functions.storage import children, delete, exists, materialize
from specimen_spark.functions.text import not_blank, title_first, trimws
from specimen_spark.sources.retrieval import RECORDSET_COLUMN, TAXON_COLUMNS, with_columns_of

#: Where a record lies: its BIN, or its processid where it has none.
PLACE = "_place"
RECORDSET, NAME, SPLIT = "recordset", "name", "processid"


def _placed(df: DataFrame, widen=None) -> DataFrame:
    place = F.when(not_blank("bin_uri"), F.col("bin_uri")).otherwise(F.coalesce("processid", F.lit("")))
    return with_columns_of(df, widen, ["bin_uri", "processid"]).withColumn(PLACE, place).select(*df.columns, PLACE)


def bucket_of(column, buckets: int):
    """The bucket that Spark gives a value of a bucketed table."""
    return F.pmod(F.hash(column), F.lit(buckets)).cast("int")


def write_universe(df: DataFrame, path: str, buckets: int, delimiter: str = ",", widen=None) -> "StoredUniverse":
    """Write records and index below ``path``; about one file a bucket. What was there is replaced.

    ``widen``, a row-wise function that passes further columns on, gives the records of compact rows: these
    are shuffled and stored then, and records are derived where they are read.
    """
    spark, table = df.sparkSession, _table_name(path)
    spark.sql(f"drop table if exists {table}")
    if exists(spark, path):
        delete(spark, path)
    (
        _placed(df, widen).repartition(buckets, PLACE).write.bucketBy(buckets, PLACE).sortBy(PLACE)
        .option("path", f"{path}/records").format("parquet").saveAsTable(table)
    )
    store = StoredUniverse(spark, path, buckets, widen)
    rows = store.records().withColumn("bucket", bucket_of(PLACE, buckets))
    ranks = [c for c in TAXON_COLUMNS if c in rows.columns]
    entries = []
    if RECORDSET_COLUMN in rows.columns:
        # codes are tested on distinct texts, far fewer than records
        texts = rows.select(RECORDSET_COLUMN, "bucket").distinct()
        codes = F.explode(F.transform(F.split(RECORDSET_COLUMN, delimiter), lambda c: trimws(c)))
        entries.append(texts.select(F.lit(RECORDSET).alias("kind"), codes.alias("code"), "bucket"))
    if ranks:
        tuples = rows.select(*ranks, "bucket").distinct()
        entries.append(tuples.select(F.lit(NAME).alias("kind"), F.explode(F.array_compact(F.array(*ranks))).alias("code"), "bucket"))
    index = entries[0].distinct() if entries else None
    for more in entries[1:]:
        index = index.unionByName(more.distinct())
    split = split_places(rows, buckets).select(F.lit(SPLIT).alias("kind"), F.col("processid").alias("code"), "bucket")
    index = split if index is None else index.unionByName(split)
    index.repartitionByRange("kind", "code").sortWithinPartitions("kind", "code").write.parquet(f"{path}/index")
    return store


def split_places(rows: DataFrame, parts: int) -> DataFrame:
    """(processid, bucket) of the processids that lie in several buckets.

    Pairs move once, by processid, into parts that a task holds in memory; there they are made distinct and counted.
    """
    pairs = rows.filter("processid is not null").select("processid", "bucket").repartition(parts, "processid").distinct()
    counted = pairs.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("processid")))
    return counted.filter("_n > 1").select("processid", "bucket")


_LOCK = threading.RLock()


def stored_once(df: DataFrame, folder: str, source: str, buckets: int, widen=None) -> "StoredUniverse":
    """The store of records whose sources' state ``source`` names; written on first use, whole or not at all."""
    path = f"{folder}/universe-{hashlib.sha256(source.encode()).hexdigest()[:16]}"
    with _LOCK:
        if exists(df.sparkSession, f"{path}/index/_SUCCESS"):
            return StoredUniverse(df.sparkSession, path, buckets, widen)
        return write_universe(df, path, buckets, widen=widen)


def _table_name(path: str) -> str:
    return "universe_" + hashlib.sha256(path.encode()).hexdigest()[:16]


class StoredUniverse:
    """An opened store. ``buckets`` and ``widen`` must be those it was written with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, widen=None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.widen = widen
        self.table = _table_name(path)
        if not spark.catalog.tableExists(self.table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/records").schema)
            spark.sql(
                f"create table {self.table} ({columns}) using parquet clustered by ({PLACE}) sorted by ({PLACE}) "
                f"into {buckets} buckets location '{path}/records'")

    def records(self, buckets: list[int] | None = None) -> DataFrame:
        """All records, or those of some buckets, from their files alone."""
        rows = self._stored(buckets)
        return self.widen(rows) if self.widen else rows

    def _stored(self, buckets: list[int] | None = None) -> DataFrame:
        if buckets is None:
            return self.spark.table(self.table)
        schema = self.spark.table(self.table).schema
        wanted = {f"{b:05d}" for b in buckets}
        files = [n for n in children(self.spark, f"{self.path}/records") if (m := re.search(r"_(\d{5})(?:\.c\d+)?\.", n)) and m[1] in wanted]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/records/{n}" for n in files])

    def _found(self, rows: DataFrame) -> DataFrame:
        rows = rows.drop(PLACE)
        return self.widen(rows) if self.widen else rows

    def buckets_of(self, kind: str, codes: DataFrame) -> list[int]:
        """Buckets that hold one of the codes (one column); at most as many as there are buckets."""
        index = self.spark.read.parquet(f"{self.path}/index").filter(F.col("kind") == kind)
        wanted = codes.toDF("code").distinct()
        return sorted(r[0] for r in index.join(wanted, "code", "left_semi").select("bucket").distinct().collect())

    # --- retrieval -----------------------------------------------------------------------

    def by_recordsets(self, codes, delimiter: str = ",") -> DataFrame:
        """Records of the given dataset or project codes; as ``retrieval.by_datasets``."""
        if not isinstance(codes, DataFrame):
            codes = self.spark.createDataFrame([(c,) for c in codes], "_code string")
        wanted = codes.toDF("_code").select(trimws("_code").alias("_code")).filter("_code <> ''").distinct()
        rows = with_columns_of(self._stored(self.buckets_of(RECORDSET, wanted)), self.widen, [RECORDSET_COLUMN])
        members = F.transform(F.split(F.col(RECORDSET_COLUMN), delimiter), lambda c: trimws(c))
        hits = materialize(
            rows.select(RECORDSET_COLUMN).distinct().select(RECORDSET_COLUMN, F.explode(members).alias("_code"))
            .join(wanted, "_code", "left_semi").select(RECORDSET_COLUMN).distinct(), "recordsets")
        return self._found(rows.join(hits, RECORDSET_COLUMN, "left_semi").select(*rows.columns))

    def by_taxa(self, names: DataFrame) -> DataFrame:
        """Records whose name at any rank is one of the names, and all of their processids; as ``retrieval.by_taxa``."""
        column = names.columns[0] if "name" not in names.columns else "name"
        wanted = names.select(title_first(column).alias("_name")).filter(not_blank("_name")).distinct()
        first = self.buckets_of(NAME, wanted)
        rows = self.records(first)  # of which the join below sees a key and names
        ranks = F.array(*[F.col(c) for c in TAXON_COLUMNS if c in rows.columns])
        keys = (
            rows.select("processid", F.explode(F.array_compact(F.array_distinct(ranks))).alias("_name"))
            .join(wanted, "_name", "left_semi").select("processid").distinct()
        )
        more = self.buckets_of(SPLIT, keys)
        rows = with_columns_of(self._stored(sorted({*first, *more})), self.widen, ["processid"])
        return self._found(rows.join(keys, "processid", "left_semi").select(*rows.columns))

    def expand_bins(self, current: DataFrame) -> DataFrame:
        """Append all records of any BIN in the current set: one hop, first copy wins; as ``retrieval.expand_bins``."""
        bins = current.filter(not_blank("bin_uri")).select(F.col("bin_uri").alias(PLACE)).distinct()
        rows = with_columns_of(self._stored(), self.widen, ["processid", "bin_uri"])
        members = rows.filter(not_blank("bin_uri")).join(bins, PLACE, "left_semi")
        held = current.select(F.col("processid").alias("_held"))
        new = self._found(members.join(held, members.processid.eqNullSafe(held._held), "left_anti").select(*rows.columns))
        return current.unionByName(new.select(*current.columns))
