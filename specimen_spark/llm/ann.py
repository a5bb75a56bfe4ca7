"""Approximate nearest neighbours by cosine: robust-pruned directed graphs, one per shard.

Equal vectors are one class; a class keeps its k + 1 smallest ids, which is all that k nearest
neighbours with ties to smaller ids can need. Classes are dealt to shards of about ``SHARD_ROWS`` by
hash. In a shard, points are inserted in batches: a greedy beam search on the graph so far proposes
neighbours, and pruning keeps a near one only if no kept neighbour is closer to it by the factor
``ALPHA``, so edges stay few and point in many directions. A second round over all points repairs what
early insertions could not see.

Every query searches every shard's graph by beam search; queries come in blocks, so a task holds one
shard and one block. The shards' best are ranked by the exact cosine of the original vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specimen_spark.llm.common import prepared, staged, table

SHARD_ROWS = 2048
QUERY_BLOCK = 1024
DEGREE = 24
BEAM = 64
ALPHA = 1.2
NEAREST = 5
BATCH = 128
STEP = 4  # nodes of a beam that are expanded at once


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int):
    """Ids and distances (queries x beam, nearest first, -1: none) found from ``entry``.

    ``x`` and ``q`` are unit vectors; the distance is Euclidean. All queries advance together.
    """
    n = len(q)
    rows = np.arange(n)
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = _distance(q @ x[entry])
    seen = np.zeros((n, len(x)), bool)
    seen[:, entry] = True
    while True:
        ahead = np.where(done, np.inf, dist)
        pick = np.argpartition(ahead, min(STEP, beam) - 1, axis=1)[:, :STEP] if beam > STEP else np.argsort(ahead, axis=1)
        open_ = np.isfinite(np.take_along_axis(ahead, pick, 1))
        some = open_.any(axis=1)
        if not some.any():
            return ids, dist
        act, pick, open_ = rows[some], pick[some], open_[some]
        done[act[:, None], pick] = True
        node = np.where(open_, ids[act[:, None], pick], -1)
        near = np.where(node[:, :, None] >= 0, edges[np.maximum(node, 0)], -1).reshape(len(act), -1)
        near = np.sort(near, axis=1)  # a node that two expanded nodes name counts once
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        near = np.where(fresh, near, entry)
        fresh &= ~seen[act[:, None], near]
        seen[act[:, None], near] = True
        d = _distance(np.matmul(x[near], q[act][:, :, None])[:, :, 0])
        d[~fresh] = np.inf
        all_d = np.concatenate([dist[act], d], axis=1)
        all_i = np.concatenate([ids[act], np.where(fresh, near, -1)], axis=1)
        all_o = np.concatenate([done[act], ~fresh], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[act] = np.take_along_axis(all_d, order, 1)
        ids[act] = np.take_along_axis(all_i, order, 1)
        done[act] = np.take_along_axis(all_o, order, 1)


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def robust_prune(x: np.ndarray, points: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours (points x degree, -1: none) out of each point's ``pool`` (-1: none)."""
    pool = np.sort(pool, axis=1)
    valid = (pool >= 0) & (pool != points[:, None])
    valid[:, 1:] &= pool[:, 1:] != pool[:, :-1]
    near = x[np.maximum(pool, 0)]
    d = np.where(valid, _distance(np.matmul(near, x[points][:, :, None])[:, :, 0]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    pool, d = np.take_along_axis(pool, order, 1), np.take_along_axis(d, order, 1)
    near = np.take_along_axis(near, order[:, :, None], 1)
    alive = np.isfinite(d)
    out = np.full((len(points), degree), -1, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        first = np.argmax(alive, axis=1)
        has = alive[rows, first]
        if not has.any():
            break
        out[has, k] = pool[has, first[has]]
        chosen = near[rows, first]
        between = _distance(np.matmul(near, chosen[:, :, None])[:, :, 0])
        alive &= alpha * between > d
        alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA):
    """(edges, entry) of unit vectors ``x``; the order of insertion is fixed by their number."""
    n = len(x)
    edges = np.full((n, degree), -1, np.int64)
    entry = int(np.argmax(x @ x.mean(axis=0)))
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    for a in (1.0, alpha):
        at = 1 if a == 1.0 and alpha != 1.0 else 0
        while at < n:
            size = min(BATCH, max(1, at), n - at) if a == 1.0 else min(BATCH, n - at)
            points = order[at : at + size]
            found, _ = beam_search(x, edges, entry, x[points], beam)
            edges[points] = robust_prune(x, points, np.concatenate([found, edges[points]], axis=1), degree, a)
            _add_back(x, edges, points, degree, a)
            at += size
    return edges, entry


def _add_back(x, edges, points, degree, alpha):
    """Let each new neighbour name the point in return, pruning lists that grow too long."""
    target = edges[points].ravel()
    source = np.repeat(points, edges.shape[1])
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    uniq, begin, count = np.unique(target, return_index=True, return_counts=True)
    if not len(uniq):
        return
    extra = np.full((len(uniq), count.max()), -1, np.int64)
    extra[np.repeat(np.arange(len(uniq)), count), np.arange(len(target)) - np.repeat(begin, count)] = source
    pool = np.concatenate([edges[uniq], extra], axis=1)
    edges[uniq] = robust_prune(x, uniq, pool, degree, alpha)


def valid_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) with an id and a finite vector of some length; repeated rows once."""
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    some = F.exists(vec, lambda v: v != 0)
    return rows.select(F.col("vec_id").cast("long"), vec.alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & some)


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """(rep, ids, embedding): each different vector once, with its k + 1 smallest ids."""
    place = F.dense_rank().over(W.partitionBy("embedding").orderBy("vec_id"))
    least = rows.withColumn("_p", place).filter(F.col("_p") <= k + 1)
    return least.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(
        F.col("ids")[0].alias("rep"), "ids", "embedding")


GRAPH = "dim int, shard int, rep long, ids array<long>, embedding array<double>, edges binary, entry boolean"


def _unit(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, norms, unit vectors) of an Arrow list column of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    full = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    scaled = full / np.abs(full).max(axis=1, keepdims=True)
    norm = np.sqrt((scaled * scaled).sum(axis=1))
    return full, norm, (scaled / norm[:, None]).astype(np.float32)


def graph_index(classes: DataFrame, shards: int) -> DataFrame:
    """The graph of each shard, a row per class; edges are row numbers in order of rep."""

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("rep")
        edges, entry = build_graph(_unit(part.column("embedding"))[2])
        return part.append_column("edges", pa.array([e.astype("<i4").tobytes() for e in edges], pa.binary())).append_column(
            "entry", pa.array(np.arange(len(edges)) == entry))

    dealt = classes.select(
        F.size("embedding").alias("dim"), F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"), "rep", "ids", "embedding")
    return dealt.groupBy("dim", "shard").applyInArrow(build, GRAPH)


def search_shards(index: DataFrame, queries: DataFrame, shards: int, blocks: int, k: int, beam: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each shard for each query."""

    def search(graph: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if graph.num_rows and asked.num_rows:
            graph = graph.sort_by("rep")
            full, _, unit = _unit(graph.column("embedding"))
            edges = np.stack([np.frombuffer(e, "<i4") for e in graph.column("edges").to_pylist()]).astype(np.int64)
            entry = graph.column("entry").to_pylist().index(True)
            members = graph.column("ids").to_pylist()
            q_full, _, q_unit = _unit(asked.column("embedding"))
            norms, q_norms = np.sqrt((full * full).sum(axis=1)), np.sqrt((q_full * q_full).sum(axis=1))
            found, _ = beam_search(unit, edges, entry, q_unit, min(beam, len(unit)))
            for i, query in enumerate(asked.column("query_id").to_pylist()):
                near = found[i][found[i] >= 0]
                score = (full[near] @ q_full[i]) / (norms[near] * q_norms[i])
                best = sorted((-s, m) for s, c in zip(score.tolist(), near) for m in members[c] if m != query)
                for s, m in best[:k]:
                    out["query_id"].append(query)
                    out["vec_id"].append(m)
                    out["score"].append(-s)
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.float64()))})

    def numbers(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = index.withColumn("block", numbers(blocks))
    right = queries.select(
        "query_id", "embedding", F.size("embedding").alias("dim"),
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), numbers(shards).alias("shard"))
    key = ("dim", "shard", "block")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")


def nearest(rows: DataFrame, queries: DataFrame, k: int = NEAREST, beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest vectors found for each query: query_id, rank, vec_id, score.

    ``rows`` and ``queries`` have vec_id and embedding. Null ids, and vectors that are null, zero or
    hold null or non-finite components, take no part. Vectors of different lengths do not meet.
    Repeated rows count once; a query never finds its own id. Ties go to the smaller vec_id. Empty
    tables give no rows.
    """
    prepared(rows.sparkSession)
    classes = staged(vector_classes(valid_vectors(rows), k), "classes")
    shards = max(1, math.ceil(classes.count() / shard_rows))
    index = staged(graph_index(classes, shards), "graph")
    asked = valid_vectors(queries).withColumnRenamed("vec_id", "query_id").dropDuplicates(["query_id"])
    asked = staged(asked, "queries")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    found = search_shards(index, asked, shards, blocks, k, beam)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; queries are those whose vec_id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 50 == 0))
