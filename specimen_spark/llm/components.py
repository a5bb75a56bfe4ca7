"""Connected components of links between random 64-bit ids, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimen_spark.llm.common import release, staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); root names the component.

    Each round sends every node to the least id among itself and its neighbours and keeps
    the links that are left between different ids. Ids must be random (hashes), so that a round
    removes a share of them whatever the graph's shape. Minima are combined before they are
    shuffled, and joins have plain sides that Spark can split at a hub. One row, whether links
    are left, reaches the driver per round.
    """
    edges = staged(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links"
    )
    steps = []
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
            .select("node", F.least("node", "m").alias("to")),
            "contraction",
        )
        steps.append(least)
        left = least.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = least.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        mapped = edges.join(left, "a").join(right, "b")
        before, edges = edges, staged(
            mapped.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a <> b").distinct(),
            "links",
        )
        release(before)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].select("node", F.col("to").alias("root"))
    for step in steps[1:]:
        nxt = step.select(F.col("node").alias("root"), "to")
        out = out.join(nxt, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    found = staged(out, "components")
    release(edges, *steps)
    return found
