"""Benchmark decontamination with DataFrame functions only.

Every benchmark item is cut into windows of ``n`` words (an item of fewer words is one window).
The windows' hashes, kept with their words, are the build side of a hash join; documents are
scanned once, a hash for each of their word windows is probed, and hits are verified by comparing
words. Only hits and one marker row per document are shuffled.

The build side is broadcast after its windows were counted against ``MAX_BROADCAST``; a larger
benchmark is joined by hash with a shuffle, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.llm.common import staged, table, without

WORDS = 10
#: Windows that may be broadcast: about 200 bytes each, so some 100 MB.
MAX_BROADCAST = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What separates words, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Normalised words; null has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def windows_of(words: Column, length: int) -> Column:
    """(pos from 1, len, h) of every window of ``length`` words."""
    last = F.size(words) - length + 1
    return F.when(
        last >= 1,
        F.transform(
            F.sequence(F.lit(1), last),
            lambda i: F.struct(
                i.alias("pos"), F.lit(length).alias("len"),
                F.xxhash64(F.slice(words, i, length)).alias("h"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<pos:int,len:int,h:bigint>>"))


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct (item_id, len, h, window) of all items; items without words have none."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.lit(n), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    return (
        items.withColumn("len", length)
        .select("item_id", "len", "w", F.explode(starts).alias("i"))
        .select("item_id", "len", F.expr("slice(w, i, len)").alias("window"))
        .withColumn("h", F.xxhash64("window")).distinct()
    )


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """Verified windows per document row, and a marker for each document row.

    Rows: doc (number of the input row), doc_id, n_words, pos (0: marker), len, item_id. All come
    from one scan; the row number is made in the tasks that scan, ahead of the only shuffle.
    """
    spark = docs.sparkSession
    known = staged(benchmark_windows(benchmark, n), "windows")
    lengths = [r[0] for r in known.select("len").distinct().collect()]  # n values at most
    marker = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("h")))
    probes = [marker, *[windows_of(F.col("w"), k) for k in sorted(lengths)]]
    scanned = docs.select(
        F.monotonically_increasing_id().alias("doc"), F.col("doc_id"), words_of(F.col("text")).alias("w")
    )
    exploded = scanned.select(
        "doc", "doc_id", "w", F.size("w").alias("n_words"), F.explode(F.concat(*probes)).alias("p")
    ).select("doc", "doc_id", "w", "n_words", "p.pos", "p.len", F.col("p.h").alias("h"))
    end = spark.range(1).select(
        F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("klen"),
        F.array().cast("array<string>").alias("window"), F.lit(0).cast("long").alias("kh"),
    )
    build = known.select(F.col("item_id").cast("long"), F.col("len").alias("klen"), "window", F.col("h").alias("kh")).union(end)
    if known.count() <= MAX_BROADCAST:
        build = F.broadcast(build)
    found = exploded.join(build, (F.col("h") == F.col("kh")) & (F.col("len") == F.col("klen")))
    same = (F.col("len") == 0) | (F.expr("slice(w, greatest(pos, 1), len)") == F.col("window"))
    return found.filter(same).select("doc", "doc_id", "n_words", "pos", "len", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if any occurrence of a window covers it. Null and empty texts have no words
    and no hits; repeated rows are judged one by one; null ids stay null. An empty benchmark
    hits nothing. A benchmark item of null id counts as item ``null``.
    """
    found = hits(docs, benchmark, n)
    per_position = found.groupBy("doc", "doc_id", "n_words", "pos").agg(
        F.max("len").alias("len"), F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("null"))).alias("items")
    )
    spans = F.array_sort(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "len"))))
    per_doc = per_position.groupBy("doc").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"),
        spans.alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(
            F.when(F.col("pos") > 0, F.col("items")))))).alias("items"),
    )
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a.n + F.greatest(F.lit(0), s.pos + s.len - F.greatest(s.pos, a.end))).alias("n"),
            F.greatest(a.end, s.pos + s.len).alias("end"),
        ),
        lambda a: a.n.cast("long"),
    )
    return per_doc.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "spans",
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """The documents without any hit, with all their columns.

    A document is told by its id and text, so repeated rows stay or go together.
    """
    marked = hits(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), benchmark, n)
    bad = staged(marked.filter("pos > 0").select("doc_id").distinct(), "contaminated")
    return without(docs, "xxhash64(row.doc_id, row.text)", bad)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("spans")


OP1_SQL = r"""
with bw as (
  select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark where text is not null),
b as (
  select distinct item_id, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') win
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from bw where len(w) > 0)),
dw as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
lens as (select distinct n from b),
d as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from dw, lens where len(w) >= n)),
hit as (select d.doc_id, d.i, d.n, b.item_id from d join b on d.win = b.win and d.n = b.n),
pos as (select distinct doc_id, unnest(range(i, i + n)) p from hit),
np as (select doc_id, count(*) n_hit from pos group by 1),
it as (select doc_id, count(distinct item_id) n_items,
  sha256(string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar))) items_sha256
  from hit group by 1)
select dw.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  coalesce(items_sha256, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join np using (doc_id) left join it using (doc_id)
"""
