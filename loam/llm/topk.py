"""Exact top-k inner-product search in tiles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Below this, sums of products of integers are exact in 64-bit floats and, for the second, in 64-bit integers.
_FLOAT_EXACT, _INT_EXACT = 2.0**52, 2.0**62
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def finite_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec, dim) of the usable rows."""
    inf = F.lit(float("inf"))
    usable = F.forall(F.col("vec"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & usable)
    return rows.withColumn("dim", F.size("vec"))


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), also where the product is beyond all floats."""
    product = x * scale
    return math.floor(product) if math.isfinite(product) else int(x) * scale


def integer_scores(queries: np.ndarray, shard: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of vectors whose components become floor(scale * x), exact.

    Almost all pairs are small enough for one product of float matrices. Where the largest components
    of two vectors could pass 2**52, the pair is done in 64-bit integers, and where those could
    overflow, in whole numbers of any size; a score beyond the range of a long becomes its end.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        q, c = np.floor(queries * scale), np.floor(shard * scale)
        most = np.outer(np.abs(q).max(axis=1, initial=0), np.abs(c).max(axis=1, initial=0)) * max(1, q.shape[1])
        most = np.where(np.isnan(most), np.inf, most)
        plain = most < _FLOAT_EXACT
        if plain.all():
            return (q @ c.T).astype(np.int64)
        out = np.where(plain, q @ c.T, 0.0).astype(np.int64)
    small_q, small_c = (np.abs(x).max(axis=1, initial=0) < _INT_EXACT for x in (q, c))
    whole = ~plain & (most < _INT_EXACT) & small_q[:, None] & small_c[None]
    rows, columns = np.flatnonzero(whole.any(axis=1)), np.flatnonzero(whole.any(axis=0))
    at = np.ix_(rows, columns)
    out[at] = np.where(whole[at], q[rows].astype(np.int64) @ c[columns].astype(np.int64).T, out[at])
    for i, j in zip(*np.nonzero(~plain & ~whole)):
        exact = sum(_whole(float(x), scale) * _whole(float(y), scale) for x, y in zip(queries[i], shard[j]))
        out[i, j] = min(max(exact, _LEAST), _MOST)
    return out


def _tile_tops(k: int, scale: int | None):
    def scored(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
        return queries @ shard.T if scale is None else integer_scores(queries, shard, scale)

    def best_of(row: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The k best among ``others``, ties to the first; they are in order of their ids."""
        row = row[others]
        if len(row) > k:
            near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
            row, others = row[near], others[near]
        # bitwise not turns integers round without overflow
        return others[np.argsort(-row if scale is None else ~row, kind="stable")[:k]]

    def tops(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        """Of each query, the k best of the shard: one matrix product, then a partial selection."""
        out: list[tuple] = []
        if len(queries) and len(shard):
            tile = int(shard["c_shard"].iloc[0])
            ids = shard["c_id"].to_numpy(np.int64)
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], np.stack(shard["c_vec"].to_numpy())[order]
            for at in range(0, len(queries), 256):
                block = queries.iloc[at : at + 256]
                scores = scored(np.stack(block["vec"].to_numpy()), vectors)
                for query, row in zip(block["id"].to_numpy(np.int64), scores):
                    best = best_of(row, np.flatnonzero(ids != query))
                    out += [(int(query), tile, int(ids[j]), row[j].item()) for j in best]
        return pd.DataFrame(out, columns=["query_id", "shard", "id", "score"])

    return tops


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int | None = None,
    query_tile: int = 4096,
    shard_rows: int = 16384,
    fan_in: int = 8,
) -> DataFrame:
    """(query_id, rank, id_col, score): each query's k highest inner products, ties to the smaller id.

    Queries are the rows where ``is_query`` (over ``id``) holds; a query's own id is no candidate.
    Query tiles meet shards by hash of the id: a task multiplies one tile by one shard and keeps k
    rows of each query, so memory depends on the tile sizes only. The lists are then merged in a
    tree, ``fan_in`` shards at a time.

    With ``scale``, components become floor(scale * x), and scores are exact: longs, those beyond a
    long's range its least or largest value, with ties among these to the smaller id. Without it,
    scores are doubles.

    Vectors that are null or hold a null, NaN or infinity take no part, nor do null ids; vectors
    of different lengths don't meet. A vector without components scores 0 with others of its kind. Rows
    that repeat an id are candidates each, and a query each for the others. Fewer than k candidates
    give all of them; an empty table gives an empty result.
    """
    usable = finite_vectors(vectors, id_col, vector_col)
    counts = usable.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    shards, tiles = -(-counts["n"] // shard_rows) or 1, -(-counts["q"] // query_tile) or 1
    deal = F.xxhash64("id")
    candidates = usable.withColumn("shard", F.pmod(deal, F.lit(shards)).cast("int")).withColumn(
        "tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    )
    queries = (
        usable.where(is_query)
        .withColumn("tile", F.pmod(F.shiftright(deal, 20), F.lit(tiles)).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    key = ["dim", "tile", "shard"]
    candidates = candidates.select(*[F.col(c).alias(f"c_{c}") for c in ["id", "vec", *key]])  # no name or lineage is shared
    tops = (
        queries.groupBy(*key)
        .cogroup(candidates.groupBy(*[f"c_{c}" for c in key]))
        .applyInPandas(_tile_tops(k, scale), f"query_id long, shard int, id long, score {'double' if scale is None else 'long'}")
    )
    best = [F.col("score").desc(), F.col("id")]
    while True:
        shards = -(-shards // fan_in)
        last = shards <= 1
        tops = tops.withColumn("shard", F.floor(F.col("shard") / fan_in).cast("int"))
        group = Window.partitionBy("query_id", *([] if last else ["shard"])).orderBy(*best)
        tops = tops.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= k)
        if last:
            return tops.select("query_id", "rank", F.col("id").alias(id_col), "score")
        tops = tops.drop("rank")
