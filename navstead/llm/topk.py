"""Exact top-k inner-product search by tiled matrix products.

Queries form tiles, candidates form shards, and every tile meets every shard as one matrix
product.  A tile keeps only the best k of each query, a task merges the lists of the shards it
sees, and the final ranking prunes again before and after its shuffle, so lists merge as a tree.
Scores are exact integers and ties go to the smaller id, hence the result depends on no order.

Defined cases: an item is an id; repeated rows of an id are one item, whose score is the best
among its vectors, and a query never meets its own id.  Vectors that are null, hold a null or a
non-finite component, or have a null id take no part.  Vectors of different lengths have no
product and do not meet.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

QUERY_TILE, SHARD, TILES_PER_GROUP = 1024, 4096, 4
LISTS = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Distinct (vec_id, dim, v) of the rows that take part; v holds floor(scale * x)."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(finite)
    floors = F.transform(v, lambda x: F.floor(x * scale).cast("double"))
    return rows.select("vec_id", F.size(v).alias("dim"), floors.alias("v")).distinct()


def best_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of the k highest scores, ties to the lower column; int64 scores."""
    n, k = scores.shape[1], min(k, scores.shape[1])
    if np.abs(scores).max(initial=0) < 2**62 // max(n, 1):
        key = scores * n + np.arange(n - 1, -1, -1)  # distinct in a row
        top = np.argpartition(key, n - k, axis=1)[:, n - k :]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def product(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where every partial sum is an exact double, else in int64."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * max(1, queries.shape[1])
    if largest < 2**53:
        return (queries @ shard.T).astype(np.int64)
    return queries.astype(np.int64) @ shard.astype(np.int64).T


def tile_lists(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, vec ids, scores) of the k best of each query, over shards of one group."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    firsts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    for a in range(0, len(query_ids), QUERY_TILE):
        q_ids, q = query_ids[a : a + QUERY_TILE], queries[a : a + QUERY_TILE]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for b in range(0, len(firsts), SHARD):
            mine = firsts[b : b + SHARD]
            end = firsts[b + SHARD] if b + SHARD < len(firsts) else len(ids)
            scores = product(q, vectors[mine[0] : end])
            if len(mine) < end - mine[0]:  # several vectors of one id
                scores = np.maximum.reduceat(scores, mine - mine[0], axis=1)
            top_ids = np.broadcast_to(ids[mine], scores.shape)
            # a query's own id sorts last and is dropped below
            own = top_ids == q_ids[:, None]
            low = scores.min(initial=0) - 1
            best = best_columns(np.where(own, low, scores), k + 1)
            found.append((np.take_along_axis(top_ids, best, 1), np.take_along_axis(scores, best, 1)))
        near, score = (np.concatenate(x, axis=1) for x in zip(*found, strict=True))
        rows = np.broadcast_to(np.arange(len(q_ids))[:, None], near.shape).ravel()
        near, score = near.ravel(), score.ravel()
        keep = near != q_ids[rows]
        rows, near, score = rows[keep], near[keep], score[keep]
        best = np.lexsort((near, -score, rows))
        rows, near, score = rows[best], near[best], score[best]
        starts = np.searchsorted(rows, rows, side="left")
        keep = np.arange(len(rows)) - starts < k
        yield q_ids[rows[keep]], near[keep], score[keep]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each row that ``is_query`` chooses."""
    asked = integer_vectors(vectors.where(is_query), id_col, vector_col, scale)
    items = cut_lineage(integer_vectors(vectors, id_col, vector_col, scale))
    n_items, n_asked = items.count(), asked.count()
    tiles, shards = max(1, -(-n_asked // QUERY_TILE)), max(1, -(-n_items // (SHARD * TILES_PER_GROUP)))
    spot = F.xxhash64("vec_id", "v")
    asked = asked.withColumn("tile", F.pmod(spot, F.lit(tiles))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    items = items.withColumn("shard", F.pmod(spot, F.lit(shards))).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(t.num_rows, -1) if t.num_rows else flat.reshape(0, 0)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
        if left.num_rows and right.num_rows:
            ids = [t.column("vec_id").to_numpy() for t in (left, right)]
            for part in tile_lists(ids[0], matrix(left), ids[1], matrix(right), k):
                for kept, new in zip(columns, part, strict=True):
                    kept.append(new)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, columns), strict=True)))

    keys = ["dim", "tile", "shard"]
    lists = asked.groupBy(*keys).cogroup(items.groupBy(*keys)).applyInArrow(meet, LISTS)
    best = lists.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # one row per pair of items
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
