"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Its result is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.llm.common import staged, table
from specimen_spark.llm.decontaminate import keep_uncontaminated
from specimen_spark.llm.jaccard import keep_leaders
from specimen_spark.llm.linededup import dedup_lines
from specimen_spark.llm.packing import pack, tokenizer_path
from specimen_spark.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones, short lines too; those of which no word is left go."""
    out = dedup_lines(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"\S")
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))
    return out.filter(left).withColumn("n_chars", n_chars.cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, null ids last."""
    return keep_leaders(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences with their token ids."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]

#: SQL can express neither the classifier's model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
