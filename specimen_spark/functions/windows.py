"""First-per-key and position-in-group, written to survive a key that holds a third of all rows."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specimen_spark.functions.storage import materialize

def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key in the given order.

    ``row_number() = 1`` is planned with a partial window group limit: every map task
    keeps one row per key before the shuffle, so a hot key sends one row per task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def with_position(df: DataFrame, group: str, score: str, key: str, out: str = "pos") -> DataFrame:
    """Position (from 1) inside each group: ``score`` descending, nulls last, then ``key``.

    Rows are written once, range-partitioned in this order, so a group of any size is cut into
    parts whose partition numbers ascend. A row's position is its number inside its part plus the
    rows of the group's earlier parts; of those only counts meet in one place.
    """
    order = [F.col(score).desc_nulls_last(), F.col(key).asc()]
    spread = df.repartitionByRange(F.col(group).asc(), *order).withColumn("_part", F.spark_partition_id())
    rows = materialize(spread, "positions")
    before = W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        rows.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        .select("_g", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    numbered = rows.withColumn("_in", F.row_number().over(W.partitionBy(group, "_part").orderBy(*order)))
    return (
        numbered.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
        .withColumn(out, (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_part", "_g", "_p", "_before", "_in")
    )
