"""Connected components of an undirected graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loam.session import discard, written


def _with_least(edges: DataFrame, least: DataFrame, end: str, total: int) -> DataFrame:
    """(a, b, m): ``edges`` with the least neighbour of their end, from (u, m, n) with n neighbours each.

    A node with more than a 500th of all edges would be one task's work in a shuffled join. There
    are at most 1000 of those, as each edge counts for two nodes, so they are broadcast.
    """
    most = max(64, total // 500)
    hubs = least.where(F.col("n") > most).select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    dealt = edges.join(F.broadcast(hubs), F.col(end) == F.col("hub"), "left")
    far = dealt.where("hub IS NOT NULL").select("a", "b", F.col("hub_m").alias("m"))
    near = dealt.where("hub IS NULL").select("a", "b").join(least.where(F.col("n") <= most), F.col(end) == F.col("u"))
    return near.select("a", "b", "m").union(far)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Each round hangs every node's larger neighbours on its smallest one (large star), then its
    smaller neighbours (small star), which ends in stars around the components' minima after
    about the logarithm of the longest path. Rounds only join and aggregate; the edges, never
    more than at first, are written to the shared folder each round, and the round before is deleted.

    Loops and repeated edges are allowed and null ends ignored; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    found = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(a.isNotNull() & b.isNotNull())
    loops = found.where(a == b).select("a", "b").distinct()
    now = written(found.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    before, total = None, now.count()
    for _ in range(max_rounds):
        # large star: of each node, every larger neighbour to the smallest neighbour or the node itself
        both = now.select("a", "b").union(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy(a.alias("u")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        least = written(least.select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = _with_least(both.where(b > a), least, "a", total).select(F.col("m").alias("a"), "b").where(a != b).distinct()
        large = written(large, "stars")
        discard(least, now)
        # small star: every smaller neighbour, and the node itself, to the smallest one
        least = written(large.groupBy(b.alias("u")).agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        hung = _with_least(large, least, "b", total)
        small = hung.select(F.col("m").alias("x"), a.alias("y")).union(least.select(F.col("m").alias("x"), F.col("u").alias("y")))
        now = written(small.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        discard(least, large)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before, total = seen, seen[0]
    else:
        raise RuntimeError("connected components did not settle")
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component"))
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return stars.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
