"""A join whose hot keys are measured and spread, whatever adaptive execution does."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of all rows above which a key is hot; there are fewer hot keys than one over it.
SHARE = 1 / 256
#: Most parts a key is cut into.
PARTS = 1024


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """Inner join on one column; ``keyed`` has few rows per key, ``rows`` may have a third of all under one.

    Rows are counted per key, combined on the map side. Rows of a key above the share are dealt over as
    many parts as it has shares, by a hash of all their columns, and only that key's rows of ``keyed`` are
    repeated once a part. The table of hot keys has fewer rows than one over the share, so it is
    broadcast at any size. Null keys join nothing.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    limit = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).scalar() * share
    hot = F.broadcast(
        counts.filter(F.col("_n") > limit).select("_key", F.least(F.ceil(F.col("_n") / limit), F.lit(PARTS)).cast("int").alias("_parts"))
    )
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, F.col(key) == F.col("_key"), "left").withColumn(
        "_part", F.when(parts > 1, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), parts)).otherwise(0).cast("int")
    ).drop("_key", "_parts")
    repeated = keyed.join(hot, F.col(key) == F.col("_key"), "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - 1))
    ).drop("_key", "_parts")
    return dealt.join(repeated, [key, "_part"]).drop("_part")
