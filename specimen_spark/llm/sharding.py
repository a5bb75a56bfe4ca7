"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws ``-ln(u) / weight`` with ``u`` from a hash of the row's key and
the child's path; the least draw wins. A child's draw depends on its own weight alone, so when a
weight changes, rows move only into or out of the subtree that holds it, and among the levels
above that subtree nothing else moves.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.llm.common import row_number_gapless, staged, table

#: region -> rack -> shard -> weight
Tree = Mapping[int, Mapping[int, Mapping[int, float]]]


def even_tree(regions: int, racks: int, shards: int) -> dict:
    """A tree of equal shards, numbered from 0 through all racks."""
    tree, at = {}, 0
    for region in range(regions):
        tree[region] = {}
        for rack in range(racks):
            tree[region][rack] = {at + k: 1.0 for k in range(shards)}
            at += shards
    return tree


def grown(tree: Tree, weight: float = 1.0) -> dict:
    """The tree with one more shard, in a region of its own.

    A new subtree at the top changes no weight below another region, so rows move only into the
    new shard. (A shard added to an old rack would also draw rows into its rack's neighbours.)
    """
    out = {r: {k: dict(s) for k, s in racks.items()} for r, racks in tree.items()}
    last = max(s for racks in tree.values() for shards in racks.values() for s in shards)
    out[max(out) + 1] = {0: {last + 1: weight}}
    return out


def _draw(key: Column, path: str, weight: float) -> Column:
    unit = (F.pmod(F.xxhash64(key, F.lit(path)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(unit) / float(weight)


def _least(key: Column, children: dict) -> Column:
    """The child, by its integer name, with the least draw; ties to the smaller name."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [
        F.struct(_draw(key, path, w).alias("draw"), F.lit(name).alias("child"))
        for name, (path, w) in sorted(children.items())
    ]
    return F.array_min(F.array(*draws))["child"]


def place(docs: DataFrame, tree: Tree, key: str, out: str = "shard") -> DataFrame:
    """Add the shard of each row; three narrow projections, no shuffle.

    Children of weight 0 or less get no rows. A null key hashes like one fixed value. The tree
    is part of the plan: it must be a cluster's layout, not data.
    """
    weights = {
        r: {k: {s: w for s, w in shards.items() if w > 0} for k, shards in racks.items()}
        for r, racks in tree.items()
    }
    rack_weight = {(r, k): sum(s.values()) for r, racks in weights.items() for k, s in racks.items()}
    region_weight = {r: sum(rack_weight[r, k] for k in racks) for r, racks in weights.items()}
    row_key = F.col(key)

    def chosen(cases: dict, at: Column) -> Column:
        expr = None
        for value, result in cases.items():
            expr = F.when(at == value, result) if expr is None else expr.when(at == value, result)
        return expr

    region = _least(row_key, {r: (f"{r}", w) for r, w in region_weight.items() if w > 0})
    rack = chosen(
        {
            r: _least(row_key, {k: (f"{r}/{k}", rack_weight[r, k]) for k in racks if rack_weight[r, k] > 0})
            for r, racks in weights.items() if region_weight[r] > 0
        },
        F.col("_region"),
    )
    shard = chosen(
        {
            (r * 1_000_003 + k): _least(row_key, {s: (f"{r}/{k}/{s}", w) for s, w in shards.items()})
            for r, racks in weights.items() for k, shards in racks.items() if shards
        },
        F.col("_region").cast("long") * 1_000_003 + F.col("_rack"),
    )
    return (
        docs.withColumn("_region", region).withColumn("_rack", rack)
        .withColumn(out, shard.cast("int")).drop("_region", "_rack")
    )


def shard_documents(
    docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Place every document, with its size, checksum, slot in its shard and the next growth.

    Returns doc_id, size (UTF-8 bytes + 8), text_crc32, law (``key``), shard, slot, grown_shard.
    Null text counts as empty; rows with a null id share one shard; repeated rows get a slot
    each. Other columns are not read. An empty table gives no rows.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    small = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.spark_partition_id().alias("pid"),
    )
    placed = place(place(small, tree, "doc_id"), grown(tree), "doc_id", "grown_shard")
    placed = staged(placed, "placed")
    out = row_number_gapless(placed, ["shard"], ["doc_id", "text_crc32"], "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of 3 regions with 2 racks each."""
    return shard_documents(table(spark, sf_dir, "documents"), even_tree(3, 2, 4))
